"""The lot book over a stream of transactions: one keyed state per folio, kept and recovered with the stream's checkpoint.

Rows of a folio must arrive in order of date and sequence over the batches (within a batch they are sorted); a row dated
before one already applied stops its book and is told as a problem, because lots it would have consumed may be gone.
Reversals are resolved before rows enter the stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from navloom.operators.ledger import BOOK
from navloom.operators.lots import ORDER, ROW, Lots, events_schema, frame


def stream_lot_events(rows: DataFrame) -> DataFrame:
    """Consumptions and problems of a stream of rows as ``lots.prepared`` makes them, as they happen."""
    schema = events_schema(rows)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lots = Lots(state.get[0] if state.exists else None)
        whole = pd.concat(list(batches)).sort_values(ORDER)
        out: list[dict[str, Any]] = []
        for t in whole.itertuples(index=False):
            out.extend({c: getattr(t, c) for c in BOOK} | e for e in lots.take(t, strict=False))
        state.update((lots.stored(),))
        yield frame(out, schema)

    return rows.select(*ROW).groupBy("user_id", "folio").applyInPandasWithState(run, schema, "book string", "append", GroupStateTimeout.NoTimeout)
