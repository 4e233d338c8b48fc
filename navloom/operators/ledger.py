"""The investor's ledger: which rows count, lots first in first out, positions, flows, returns, reconciliation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navloom.functions.text import financial_year

BOOK = ["user_id", "folio", "scheme_id"]
OPENING, CLOSING = ("PURCHASE", "SIP"), ("REDEMPTION",)
# Days after which a gain is long-term, days in a year, tolerances of the reconciliation.
LONG_TERM_DAYS = 365
UNIT_TOLERANCE, VALUE_TOLERANCE = 0.001, 0.005
# How long after a transaction it may be reversed, and rupees by which a switch's legs may differ.
REVERSAL_DAYS, SWITCH_TOLERANCE = 30, 1.0
#: Units and money compare exactly at these places.
UNITS_TYPE, MONEY_TYPE = "decimal(20,6)", "decimal(20,4)"


def cents(c: Column, scale: float = 1e4) -> Column:
    """Half up at a fixed number of places, the same on every engine."""
    return F.floor(c * scale + 0.5) / scale


def drop_reversed(txns: DataFrame, ref: str = "reverses_ref") -> DataFrame:
    """Without reversal rows and the rows that they take back."""
    taken = txns.filter((F.col("txn_type") == "REVERSAL") & F.col(ref).isNotNull()).select(F.col(ref).alias("txn_ref")).distinct()
    return txns.filter(F.col("txn_type") != "REVERSAL").join(taken, "txn_ref", "left_anti")


def sequenced(txns: DataFrame) -> DataFrame:
    """Ordinal within folio, scheme and day, from 0."""
    return txns.withColumn("txn_seq", F.row_number().over(Window.partitionBy(*BOOK, "txn_date").orderBy("txn_ref")) - 1)


def with_ids(txns: DataFrame) -> DataFrame:
    """A digest of the fields that make a transaction what it is; the same row read twice has the same id."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*BOOK, "txn_date", "txn_seq", "txn_type", "units", "amount")]
    return txns.withColumn("txn_id", F.sha2(F.concat_ws("|", *fields), 256))


def by_group(rows: DataFrame, keys: list[str], order: list[str], run: Callable[[list[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """``run`` over the rows of each group of ``keys``, sorted by ``order``; its tuples as rows of ``schema``.

    Groups are dealt over tasks, and a task goes once through its sorted rows: one call for each batch, not for each of many small groups.
    """
    names, width = [f.strip().split(" ")[0] for f in schema.split(",")], len(keys)

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            plain = (batch[c].astype(object).where(batch[c].notna(), None) for c in batch.columns)
            for row in zip(*plain, strict=True):
                if group and row[:width] != group[0][:width]:
                    out.extend(run(group))
                    group = []
                group.append(row)
            yield pd.DataFrame(dict(zip(names, (pd.Series(c, dtype=object) for c in zip(*out)))) if out else {n: pd.Series([], dtype=object) for n in names})
            out = []
        if group:
            out.extend(run(group))
            yield pd.DataFrame(dict(zip(names, (pd.Series(c, dtype=object) for c in zip(*out)))) if out else {n: pd.Series([], dtype=object) for n in names})

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(tables, schema)


def link_reversals(txns: DataFrame, days: int = REVERSAL_DAYS) -> DataFrame:
    """Per reversal: reversal_ref and the txn_ref that it takes back, null for an orphan.

    Reversals come in the order of date and reference. Each takes the latest transaction of its book that has the
    opposite units, is at most ``days`` older and was not taken back before. One group is one book and size of units.
    Reversals without units are orphans; so are those of a book without an account or scheme of their own.
    """
    units = F.col("units").cast(UNITS_TYPE)
    rows = txns.withColumn("size", F.when(F.col("txn_type") == "REVERSAL", -units).otherwise(units))
    order = ["txn_date", "txn_seq", "txn_ref"] if "txn_seq" in txns.columns else ["txn_date", "txn_ref"]
    rows = rows.select(*BOOK, "size", (F.col("txn_type") == "REVERSAL").alias("reversal"), F.to_date("txn_date").alias("day"), F.struct(*order).alias("place"), "txn_ref")
    # Sizes without a reversal have nothing to link.
    wanted = rows.filter("reversal").select(*BOOK, "size").distinct()
    work = rows.join(wanted, [*BOOK, "size"], "left_semi").select(*BOOK, "size", "day", "reversal", "place", "txn_ref")
    first = len(BOOK) + 1

    def link(group: list[tuple]) -> Iterator[tuple]:
        open_refs: list[tuple] = []
        for day, reversal, *_, ref in (row[first:] for row in group):
            if not reversal:
                open_refs.append((day, ref))
            elif open_refs and (day - open_refs[-1][0]).days <= days:
                yield ref, open_refs.pop()[1]
            else:
                yield ref, None

    kind = txns.schema["txn_ref"].dataType.simpleString()
    # Places are told by columns of their own: a batch's rows carry no structs.
    work = work.select(*BOOK, "size", "day", "reversal", *(F.col(f"place.{c}").alias(f"place_{c}") for c in order), "txn_ref")
    linked = by_group(work, [*BOOK, "size"], ["day", "reversal", *(f"place_{c}" for c in order)], link, f"reversal_ref {kind}, txn_ref {kind}")
    lone = rows.filter("reversal and size is null").select(F.col("txn_ref").alias("reversal_ref"), F.lit(None).cast(kind).alias("txn_ref"))
    return linked.union(lone)


def charge(txns: DataFrame, name: str) -> Column:
    """A charge of a transaction; 0 where it has none or the table doesn't list that charge."""
    return F.coalesce(F.col(name), F.lit(0)) if name in txns.columns else F.lit(0)


def switch_proceeds(txns: DataFrame) -> Column:
    """What a leg out sends on: its amount less exit load and transaction tax."""
    return F.abs("amount") - charge(txns, "exit_load") - charge(txns, "stt")


def switch_consideration(txns: DataFrame) -> Column:
    """What a leg in received: its amount and the stamp duty taken from it."""
    return F.abs("amount") + charge(txns, "stamp_duty")


def link_switches(txns: DataFrame, tolerance: float = SWITCH_TOLERANCE) -> DataFrame:
    """Per leg out of a switch or transfer plan: out_ref and the in_ref of its other leg, null where none is left (an unlinked switch).

    Legs out of a folio and day come in the order of reference. Each takes the first leg in that is still free and
    received what the leg out sent, within ``tolerance``. One group is one folio and day.
    """
    day = ["user_id", "folio", "txn_date"]
    out = F.col("txn_type").isin("SWITCH_OUT", "STP_OUT")
    legs = txns.filter(F.col("txn_type").isin("SWITCH_OUT", "STP_OUT", "SWITCH_IN", "STP_IN"))
    money = F.round(F.when(out, switch_proceeds(txns)).otherwise(switch_consideration(txns)).cast(MONEY_TYPE) * 10_000, 0).cast("long")
    legs = legs.select(*day, "txn_ref", out.alias("out"), money.alias("money"))

    legs = legs.select(*day, "txn_ref", "out", "money")
    room = round(tolerance * 10_000)
    width = max(room, 1)

    def pair(group: list[tuple]) -> Iterator[tuple]:
        # Free legs in by steps of the tolerance, each step in order of reference, so a leg out looks at three steps only.
        free: dict[int, list[tuple]] = {}
        for place, (*_, ref, is_out, money) in enumerate(group):
            if not is_out and money is not None:
                free.setdefault(int(money) // width, []).append((place, int(money), ref))
        for *head, ref, is_out, money in group:
            if not is_out:
                continue
            found = None
            if money is not None:
                step, sent = int(money) // width, int(money)
                near = (next((x for x in free.get(k, ()) if abs(x[1] - sent) <= room), None) for k in (step - 1, step, step + 1))
                found = min((x for x in near if x), default=None, key=lambda x: x[0])
            if found:
                free[found[1] // width].remove(found)
            yield *head, ref, found[2] if found else None

    kind = {f.name: f.dataType.simpleString() for f in legs.schema}
    schema = ", ".join(f"{c} {kind[c]}" for c in day) + f", out_ref {kind['txn_ref']}, in_ref {kind['txn_ref']}"
    return by_group(legs, day, ["txn_ref"], pair, schema)


def signed_units(types: Column, units: Column) -> Column:
    return F.when(types.isin(*OPENING), units).when(types.isin(*CLOSING), -units).otherwise(F.lit(0).cast("decimal(18,3)"))


def shortfalls(txns: DataFrame) -> DataFrame:
    """Books that at some point close more units than they hold."""
    running = F.sum(signed_units(F.col("txn_type"), F.col("units"))).over(Window.partitionBy(*BOOK).orderBy("txn_date", "txn_ref"))
    return txns.withColumn("held", running).groupBy(*BOOK).agg(F.min("held").alias("lowest")).filter("lowest < 0")


def fifo(txns: DataFrame) -> DataFrame:
    """Which lot each closing consumes, and what it costs and earns. Books with a shortfall must be left out before.

    Opened and closed units of a book lie on one line. The ends of lots and closings cut it into stretches; a stretch
    belongs to the first lot and the first closing that end at or after it. So one sort per book is enough, and no pair is joined.
    """
    book = Window.partitionBy(*BOOK)
    moves = txns.filter(F.col("txn_type").isin(*OPENING, *CLOSING) & (F.col("units") > 0)).withColumn("side", F.when(F.col("txn_type").isin(*OPENING), "lot").otherwise("close"))
    ends = moves.withColumn("end", F.sum("units").over(Window.partitionBy(*BOOK, "side").orderBy("txn_date", "txn_ref").rowsBetween(Window.unboundedPreceding, 0)))
    ahead = book.orderBy("end", "side", "txn_ref").rowsBetween(0, Window.unboundedFollowing)
    fact = F.struct("txn_ref", "txn_date", "units", F.col("amount").cast("double").alias("amount"), F.col("end").alias("own_end"))
    cut = ends.withColumn("lot", F.first(F.when(F.col("side") == "lot", fact), ignorenulls=True).over(ahead)).withColumn("close", F.first(F.when(F.col("side") == "close", fact), ignorenulls=True).over(ahead))
    cut = cut.withColumn("begin", F.coalesce(F.lag("end").over(book.orderBy("end", "side", "txn_ref")), F.lit(0).cast("decimal(28,3)")))
    used = cut.filter(F.col("lot").isNotNull() & F.col("close").isNotNull() & (F.col("end") > F.col("begin"))).withColumn("used", (F.col("end") - F.col("begin")).cast("double"))
    cost = F.abs(F.col("lot.amount"))
    per_lot = Window.partitionBy(*BOOK, "lot.txn_ref").orderBy("end", "side", "txn_ref")
    used = used.withColumn("rough", cents(cost / F.col("lot.units").cast("double") * F.col("used")))
    so_far = F.least(cost, F.sum("rough").over(per_lot.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.least(cost, F.coalesce(F.sum("rough").over(per_lot.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    # The consumption that empties a lot takes what is left of its cost.
    allocated = F.when(F.col("end") == F.col("lot.own_end"), cost - before).otherwise(so_far - before)
    proceeds = F.abs(F.col("close.amount")) / F.col("close.units").cast("double") * F.col("used")
    held = F.datediff("close.txn_date", "lot.txn_date")
    return used.select(
        *BOOK, F.col("lot.txn_ref").alias("lot_ref"), F.col("close.txn_ref").alias("close_ref"), F.col("close.txn_date").alias("sale_date"), "used", allocated.alias("cost"), proceeds.alias("proceeds"),
        held.alias("holding_days"), F.when(held > LONG_TERM_DAYS, "LTCG").otherwise("STCG").alias("gain_type"), financial_year(F.col("close.txn_date")).alias("fy"),
    )


def lots_remaining(txns: DataFrame, consumed: DataFrame) -> DataFrame:
    used = consumed.groupBy(F.col("lot_ref").alias("txn_ref")).agg(F.sum("used").alias("used"), F.sum("cost").alias("used_cost"))
    lots = txns.filter(F.col("txn_type").isin(*OPENING) & (F.col("units") > 0)).join(used, "txn_ref", "left")
    left = F.col("units").cast("double") - F.coalesce("used", F.lit(0.0))
    return lots.withColumn("units_left", left).filter("units_left > 0.0005").select(*BOOK, F.col("txn_ref").alias("lot_ref"), "txn_date", "units_left", (F.abs(F.col("amount").cast("double")) - F.coalesce("used_cost", F.lit(0.0))).alias("cost_left"))


def positions(txns: DataFrame, consumed: DataFrame) -> DataFrame:
    """Per book: units, cost of what is left, realised gain, first and last purchase."""
    left = lots_remaining(txns, consumed).groupBy(*BOOK).agg(F.sum("units_left").alias("units"), F.sum("cost_left").alias("cost"))
    gains = consumed.groupBy(*BOOK).agg(F.sum(F.col("proceeds") - F.col("cost")).alias("realised"))
    bought = txns.filter(F.col("txn_type").isin(*OPENING)).groupBy(*BOOK).agg(F.min("txn_date").alias("first_purchase"), F.max("txn_date").alias("last_purchase"), F.sum(F.col("amount").cast("double")).alias("invested"))
    joined = bought.join(left, BOOK, "left").join(gains, BOOK, "left").fillna(0.0, ["units", "cost", "realised"])
    return joined.withColumn("avg_cost", F.when(F.col("units") > 0, F.col("cost") / F.col("units")))


def realised_by_year(consumed: DataFrame) -> DataFrame:
    return consumed.groupBy("user_id", "fy", "gain_type").agg(F.sum("proceeds").alias("proceeds"), F.sum("cost").alias("cost"), F.sum(F.col("proceeds") - F.col("cost")).alias("gain"), F.count(F.lit(1)).alias("n"))


def cashflows(txns: DataFrame, scope: list[str], terminal: DataFrame | None = None) -> DataFrame:
    """Signed external flows per ``scope`` and day: money out of the pocket is negative. Reinvested payouts are no flow.

    ``terminal`` has the scope's columns, txn_date and flow: the value that is still there.
    """
    inward = F.col("txn_type").isin(*CLOSING, "IDCW_PAYOUT")
    flow = F.when(F.col("txn_type").isin(*OPENING), -F.abs("amount")).when(inward, F.abs("amount"))
    rows = txns.withColumn("flow", flow.cast("double")).filter("flow is not null").groupBy(*scope, "txn_date").agg(F.sum("flow").alias("flow"))
    return rows if terminal is None else rows.unionByName(terminal.select(*scope, "txn_date", "flow"))


def solve_rate(days: np.ndarray, flows: np.ndarray, guess: float = 0.15) -> float | None:
    """The annual rate at which the flows are worth nothing: Newton steps, then bisection between -0.9999 and 10."""
    if len(flows) < 2 or flows.min() >= 0 or flows.max() <= 0:
        return None
    years = (days - days.min()) / 365.0

    def worth(r: float) -> float:
        return float((flows / (1 + r) ** years).sum())

    rate = guess
    for _ in range(50):
        slope = float((-years * flows / (1 + rate) ** (years + 1)).sum())
        value = worth(rate)
        if abs(value) < 1e-7:
            return rate
        if slope == 0:
            break
        new = rate - value / slope
        if new <= -0.9999:
            new = (rate - 0.9999) / 2
        if not np.isfinite(new):
            break
        if abs(new - rate) < 1e-9:
            return new
        rate = new
    low, high = -0.9999, 10.0
    a, b = worth(low), worth(high)
    if not np.isfinite(a) or a * b > 0:
        return None
    for _ in range(200):
        mid = (low + high) / 2
        v = worth(mid)
        if abs(v) < 1e-7 or high - low < 1e-12:
            return mid
        low, high, a = (mid, high, v) if a * v > 0 else (low, mid, a)
    return (low + high) / 2


def xirr(flows: DataFrame, by: str) -> DataFrame:
    """Money-weighted return per key. Days are summed before, so a group holds one row per day at most."""

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        days = pd.to_datetime(group["txn_date"]).map(pd.Timestamp.toordinal).to_numpy()
        return pd.DataFrame({by: [group[by].iloc[0]], "xirr": [solve_rate(days, group["flow"].to_numpy(float))]})

    daily = flows.groupBy(by, "txn_date").agg(F.sum("flow").alias("flow"))
    return daily.groupBy(by).applyInPandas(solve, f"{by} {daily.schema[by].dataType.simpleString()}, xirr double")


def twrr(start_nav: Column, end_nav: Column, days: Column) -> tuple[Column, Column]:
    """Growth of the price, and by the year: null under one full year."""
    growth = end_nav / start_nav
    return growth - 1, F.when(days >= 365, F.exp(F.log(growth) * 365.0 / days) - 1)


def reconcile(books: DataFrame) -> DataFrame:
    """Computed against printed units (and values, where both exist): ok, warn or fail, with what may be the reason."""
    delta = F.col("units") - F.col("printed_units")
    off = F.abs(delta) > UNIT_TOLERANCE
    value_off = F.abs(F.col("value") - F.col("printed_value")) > F.abs("printed_value") * VALUE_TOLERANCE
    status = F.when(F.col("printed_units").isNull(), "warn").when(off, "fail").when(F.coalesce(value_off, F.lit(False)), "warn").otherwise("ok")
    reasons = F.array_compact(F.array(
        F.when(F.col("printed_units").isNull(), "no balance printed"), F.when(off & (delta < 0), "purchases missing"), F.when(off & (delta > 0), "redemptions missing"), F.when(F.coalesce(value_off, F.lit(False)), "price differs"),
    ))
    return books.select(*BOOK, delta.alias("units_delta"), status.alias("status"), reasons.alias("diagnosis"))


def price_check(txns: DataFrame, navs: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Printed prices against ours on the same day, per scheme: matched, mismatched, unavailable."""
    joined = txns.join(navs, (txns["scheme_id"] == navs["scheme_id"]) & (txns["txn_date"] == navs["nav_date"]), "left").select(txns["scheme_id"], "printed_nav", "nav")
    near = F.abs(F.col("printed_nav") - F.col("nav")) <= F.col("nav") * tolerance
    return joined.groupBy("scheme_id").agg(F.count_if(near).alias("matched"), F.count_if(~near).alias("mismatched"), F.count_if(F.col("nav").isNull()).alias("unavailable"))
