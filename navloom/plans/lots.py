"""Queries on the lot book and their SQL: whole-number arithmetic on overlapping stretches of opened and closed units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navloom.operators import lots as L
from navloom.operators.ledger import BOOK
from navloom.plans.base import Catalogue
from navloom.sources.analogue import prelude, view
from navloom.sources.store import shared_folder, written
from navloom.streaming.lots import stream_lot_events

C = Catalogue()

_ROWS = prelude("book_txn") + """,
k AS (SELECT *, txn_type IN ('PURCHASE', 'SIP', 'SWITCH_IN', 'STP_IN', 'IDCW_REINVEST', 'MERGER_IN') AS opens, txn_type IN ('REDEMPTION', 'SWITCH_OUT', 'STP_OUT', 'SWP', 'MERGER_OUT') AS closes FROM book_txn
      WHERE txn_type <> 'REVERSAL' AND txn_ref NOT IN (SELECT reverses_ref FROM book_txn WHERE reverses_ref IS NOT NULL)),
n AS (SELECT *, CAST(units * 1000 AS BIGINT) AS u, CAST(amount * 10000 AS BIGINT) AS m, CAST(stamp_duty * 10000 AS BIGINT) AS duty, CAST((exit_load + stt) * 10000 AS BIGINT) AS taken,
             CAST(nav * 1000000 AS BIGINT) AS sale_nav, CAST(nav_2018 * 1000000 AS BIGINT) AS old_nav,
             ROW_NUMBER() OVER (PARTITION BY user_id, folio, scheme_id, txn_date ORDER BY txn_ref) - 1 AS s FROM k),
h AS (SELECT *, SUM(CASE WHEN opens THEN u WHEN closes THEN -u ELSE 0 END) OVER (PARTITION BY user_id, folio, scheme_id ORDER BY txn_date, txn_ref) AS held FROM n)
"""  # fmt: skip
_USED = _ROWS + """,
g AS (SELECT user_id, folio, scheme_id FROM h GROUP BY 1, 2, 3 HAVING MIN(held) >= 0), w AS (SELECT n.* FROM n JOIN g USING (user_id, folio, scheme_id) WHERE u > 0),
l AS (SELECT *, m + duty AS cost, substr(sha256(concat('lot|', sha256(concat_ws('|', user_id, folio, scheme_id, txn_date, s, txn_type, CAST(units AS DECIMAL(20,6)), CAST(amount AS DECIMAL(20,4)))))), 1, 32) AS id FROM w WHERE opens),
a AS (SELECT *, (2 * cost * 100000 + u) // (2 * u) AS unit_cost, SUM(u) OVER (PARTITION BY user_id, folio, scheme_id ORDER BY txn_date, id) AS e FROM l),
c AS (SELECT *, m - taken AS net, (2 * (m - taken) * 100000 + u) // (2 * u) AS each_net, SUM(u) OVER (PARTITION BY user_id, folio, scheme_id ORDER BY txn_date, txn_ref) AS e FROM w WHERE closes),
o AS (SELECT a.user_id, a.folio, a.scheme_id, a.txn_ref AS lot_ref, a.id, c.txn_ref AS close_ref, a.txn_date AS acquired, c.txn_date AS sale_date, LEAST(a.e, c.e) - GREATEST(a.e - a.u, c.e - c.u) AS used, LEAST(a.e, c.e) = a.e AS empties,
        a.cost, a.unit_cost, a.old_nav, c.sale_nav, c.net, c.each_net
      FROM a JOIN c ON a.user_id = c.user_id AND a.folio = c.folio AND a.scheme_id = c.scheme_id AND LEAST(a.e, c.e) > GREATEST(a.e - a.u, c.e - c.u)),
r AS (SELECT *, (unit_cost * used + 50000) // 100000 AS rough, (each_net * used + 50000) // 100000 AS part, (GREATEST(unit_cost, LEAST(old_nav, sale_nav)) * used + 50000) // 100000 AS other FROM o),
z AS (SELECT *, LEAST(cost, SUM(rough) OVER (PARTITION BY lot_ref ORDER BY sale_date, close_ref)) AS s1,
        LEAST(cost, COALESCE(SUM(rough) OVER (PARTITION BY lot_ref ORDER BY sale_date, close_ref ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS s0,
        ROW_NUMBER() OVER (PARTITION BY close_ref ORDER BY acquired, id) - 1 AS sequence, ROW_NUMBER() OVER (PARTITION BY close_ref ORDER BY acquired DESC, id DESC) = 1 AS latest, SUM(part) OVER (PARTITION BY close_ref) AS parts FROM r),
y AS (SELECT *, CASE WHEN empties THEN cost - s0 ELSE s1 - s0 END AS actual, part + CASE WHEN latest THEN net - parts ELSE 0 END AS got FROM z),
x AS (SELECT *, COALESCE(acquired < DATE '2018-01-31' AND old_nav IS NOT NULL AND other > actual, FALSE) AS old FROM y)
"""  # fmt: skip
_CONSUMPTIONS = _USED + """SELECT user_id, folio, scheme_id, lot_ref, close_ref, acquired, sale_date, CAST(sequence AS INTEGER) AS sequence, CAST(used / 1000 AS DOUBLE) AS used, CAST(got / 10000 AS DOUBLE) AS net,
  CAST(CASE WHEN old THEN other ELSE actual END / 10000 AS DOUBLE) AS cost, CASE WHEN old THEN 'grandfathered' ELSE 'actual' END AS basis, CAST(sale_date - acquired AS INTEGER) AS holding_days,
  CASE WHEN sale_date - acquired > 365 THEN 'LTCG' ELSE 'STCG' END AS gain_type, CAST((got - CASE WHEN old THEN other ELSE actual END) / 10000 AS DOUBLE) AS gain,
  CASE WHEN acquired < DATE '2018-01-31' AND old_nav IS NULL THEN 'low' ELSE 'high' END AS confidence FROM x"""  # fmt: skip


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return L.prepared(view(spark, d, "book_txn"), nav_2018=F.col("nav_2018"))


def _as_doubles(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f.name).cast("double") for f in df.schema if f.dataType.simpleString().startswith("decimal")})


def _sound(events: DataFrame) -> DataFrame:
    """Events of books of which no row was refused."""
    return events.join(L.problems(events).select(*BOOK).distinct(), BOOK, "left_anti")


def _events(spark: SparkSession, d: str) -> DataFrame:
    # Written once: sound books are told from the same events.
    return written(L.lot_events(_rows(spark, d)), shared_folder(spark, "lot-events"))


@C.query(_CONSUMPTIONS)
def lot_consumptions(spark: SparkSession, d: str) -> DataFrame:
    return _as_doubles(L.consumptions(_sound(_events(spark, d))).drop("lot_id", "gross"))


@C.query(_USED + """, t AS (SELECT lot_ref, SUM(used) AS used, SUM(actual) AS actual FROM x GROUP BY 1)
SELECT user_id, folio, scheme_id, txn_ref AS lot_ref, CASE txn_type WHEN 'MERGER_IN' THEN 'merger' ELSE lower(txn_type) END AS origin, txn_date AS acquired, CAST(u / 1000 AS DOUBLE) AS units, CAST((u - COALESCE(used, 0)) / 1000 AS DOUBLE) AS units_left,
  CAST(unit_cost / 1000000 AS DOUBLE) AS unit_cost, CAST(cost / 10000 AS DOUBLE) AS cost, CAST((cost - COALESCE(actual, 0)) / 10000 AS DOUBLE) AS cost_left FROM a LEFT JOIN t ON a.txn_ref = t.lot_ref""")  # fmt: skip
def lot_balances(spark: SparkSession, d: str) -> DataFrame:
    return _as_doubles(L.all_lots(_sound(_events(spark, d))).drop("lot_id", "booked"))


@C.query(_ROWS + """, f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, folio, scheme_id ORDER BY txn_date, txn_ref) AS rk FROM h WHERE held < 0)
SELECT user_id, folio, scheme_id, txn_ref, txn_date, 'more units than the book holds' AS reason, CAST(-held / 1000 AS DOUBLE) AS short FROM f WHERE rk = 1""")  # fmt: skip
def lot_problems(spark: SparkSession, d: str) -> DataFrame:
    return _as_doubles(L.problems(L.lot_events(_rows(spark, d))))


@C.query(_CONSUMPTIONS)
def lot_stream_consumptions(spark: SparkSession, d: str) -> DataFrame:
    """The same rows as three deliveries of a stream, each a new query that recovers the books from the checkpoint."""
    place = shared_folder(spark, "lot-stream")
    rows = written(_rows(spark, d), f"{place}/rows")
    days = rows.agg(F.min("txn_date").alias("first"), F.percentile_approx(F.unix_date("txn_date"), [0.4, 0.7]).alias("cuts")).first()
    cuts = [None, *(days["cuts"] or []), None]
    for after, until in zip(cuts, cuts[1:]):
        day = F.unix_date("txn_date")
        part = rows.filter((F.lit(True) if after is None else day > after) & (F.lit(True) if until is None else day <= until))
        part.write.mode("append").parquet(f"{place}/source")
        events = stream_lot_events(spark.readStream.schema(rows.schema).parquet(f"{place}/source"))
        events.writeStream.format("parquet").option("path", f"{place}/events").option("checkpointLocation", f"{place}/books").trigger(availableNow=True).start().awaitTermination()
    return _as_doubles(L.consumptions(_sound(spark.read.schema(L.events_schema(rows)).parquet(f"{place}/events"))).drop("lot_id", "gross"))
