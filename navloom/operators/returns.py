"""What an investor earned with each position, and whether the statement agrees with the ledger.

Both start from the rows of the lot book (``lots.prepared``) and from positions that it leaves. Prices are looked up by fund and
day, never by position: a fund that everyone holds is asked once for each day.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navloom.operators.asof import latest_on_or_before
from navloom.operators.ledger import BOOK, UNIT_TOLERANCE, VALUE_TOLERANCE, twrr
from navloom.operators.lots import CLOSING_TYPES, ORDER
from navloom.operators.statement import OPENING_TYPES

# Types that move nothing in or out of a portfolio; those of them that a position does not see as money either.
NEUTRAL_TYPES = ("SWITCH_IN", "SWITCH_OUT", "STP_IN", "STP_OUT", "IDCW_REINVEST", "MERGER_IN", "MERGER_OUT", "SEGREGATION", "UNIT_SPLIT")
REINVESTED = ("IDCW_REINVEST",)
# Percent by which a printed price may differ, and what tells drift of rounded sums from missing rows.
PRICE_TOLERANCE_PCT, DRIFT_UNITS, DRIFT_ROWS = 0.5, 0.01, 100
# What users of a position's figures are told.
NOTES = ("XIRR is undefined for this cashflow pattern.", "No NAV at first purchase; TWRR unavailable.", "Held under a year, so the fund return is cumulative and not annualised; the timing effect needs both on the same basis.")


def external_flows(rows: DataFrame, portfolio: bool = False) -> DataFrame:
    """(keys, txn_date, flow): money in is negative. Sales arrive less their charges; reinvested payouts are no flow.

    Of a position, legs of switches are real entries and exits; of a portfolio (key user_id) they are not.
    """
    amount = F.abs("amount")
    charges = F.coalesce("exit_load", F.lit(0)) + F.coalesce("stt", F.lit(0))
    flow = F.when(F.col("txn_type").isin(*(NEUTRAL_TYPES if portfolio else REINVESTED)), None).when(F.col("txn_type").isin(*OPENING_TYPES), -amount)
    flow = flow.when(F.col("txn_type").isin(*CLOSING_TYPES), amount - charges).when(F.col("txn_type") == "IDCW_PAYOUT", amount)
    keys = ["user_id"] if portfolio else BOOK
    return rows.select(*keys, "txn_date", flow.cast("decimal(24,4)").alias("flow")).filter("flow is not null").groupBy(*keys, "txn_date").agg(F.sum("flow").alias("flow"))


def first_rate(days: np.ndarray, flows: np.ndarray) -> float | None:
    """The smallest yearly rate above -0.9999 at which the flows are worth nothing, where their worth changes its sign between steps of a tenth of the rate's logarithm; null if it never does.

    Flows that change direction several times have several such rates; this one does not depend on a guess.
    """
    if len(flows) < 2 or flows.min() >= 0 or flows.max() <= 0:
        return None
    years = (days - days.min()) / 365.0
    side = lambda z: np.sign((flows / np.exp(np.multiply.outer(z, years))).sum(axis=-1))
    low, steps = np.log(0.0001), np.arange(-91, 139) / 10
    with np.errstate(over="ignore"):
        at_low = side(low)
        changed = np.flatnonzero(side(steps) != at_low)
        if not len(changed):
            return None
        high = steps[changed[0]]
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if side(mid) == at_low else (low, mid)
    return float(np.expm1(low))


def money_weighted(flows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, xirr): the first yearly rate at which the flows of a key are worth nothing, null where there is none. A key's flows are one array, with one entry per day."""

    @F.pandas_udf("double")
    def solve(days: pd.Series, flows: pd.Series) -> pd.Series:
        return pd.Series([first_rate(np.asarray(d), np.asarray(f, dtype=float)) for d, f in zip(days, flows, strict=True)], dtype="float64")

    daily = flows.groupBy(*keys, "txn_date").agg(F.sum(F.col("flow").cast("double")).alias("flow"))
    listed = daily.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.unix_date("txn_date").alias("day"), "flow"))).alias("all"))
    return listed.select(*keys, solve(F.col("all.day"), F.col("all.flow")).alias("xirr"))


def priced(asks: DataFrame, navs: DataFrame, day: str, name: str) -> DataFrame:
    """``asks`` with the newest price of its fund on or before ``day`` as ``name``; null if there is none."""
    days = asks.select("scheme_id", F.col(day).alias("__day")).filter("__day is not null").distinct()
    found = latest_on_or_before(days, navs.select("scheme_id", "nav_date", F.col("nav").alias(name)), ["scheme_id"], "__day", "nav_date", [name])
    return asks.join(found.select("scheme_id", F.col("__day").alias(day), name), ["scheme_id", day], "left")


def position_returns(positions: DataFrame, rows: DataFrame, navs: DataFrame) -> DataFrame:
    """Per position (book, units, as_of, first_purchase, invested_net): its value, and four figures that are null where not defined.

    ``xirr`` is what the investor earned; ``twrr_cum`` and ``twrr_annual`` what the fund did from the first purchase on, the second only from
    a full year on; ``timing_effect`` the difference of the two yearly figures; ``absolute_return`` the gain on net money in, where that is
    positive. ``note`` says why a figure is missing. ``navs`` are adjusted for payouts. A position without a price has no value, and so no final flow and no figure but null.
    """
    valued = priced(priced(positions, navs, "first_purchase", "nav_start"), navs, "as_of", "nav_end")
    valued = valued.withColumn("market_value", F.col("units").cast("double") * F.col("nav_end").cast("double"))
    last = valued.filter("market_value is not null").select(*BOOK, F.col("as_of").alias("txn_date"), F.col("market_value").alias("flow"))
    # Rows after the day of valuation are not part of what it values.
    known = rows.join(positions.select(*BOOK, "as_of"), BOOK).filter(F.col("txn_date") <= F.col("as_of"))
    flows = external_flows(known).withColumn("flow", F.col("flow").cast("double")).unionByName(last)
    solved = valued.join(money_weighted(flows, BOOK), BOOK, "left").withColumn("xirr", F.when(F.col("market_value").isNotNull(), F.col("xirr")))
    days = F.datediff("as_of", "first_purchase")
    sound = (F.col("nav_start") > 0) & F.col("nav_end").isNotNull() & (days > 0)
    cumulative, annual = twrr(F.when(sound, F.col("nav_start").cast("double")), F.col("nav_end").cast("double"), days)
    net = F.col("invested_net").cast("double")
    out = solved.withColumn("twrr_cum", cumulative).withColumn("twrr_annual", annual)
    note = F.when(F.col("xirr").isNull(), NOTES[0]).when(F.col("nav_start").isNull(), NOTES[1]).when(F.col("twrr_annual").isNull(), NOTES[2])
    return out.select(
        *BOOK, "as_of", F.col("units").cast("double").alias("units"), "market_value", "xirr", "twrr_cum", "twrr_annual", (F.col("xirr") - F.col("twrr_annual")).alias("timing_effect"),
        F.when(net > 0, (F.col("market_value") - net) / net).alias("absolute_return"), note.alias("note"),
    )


def price_witness(rows: DataFrame, navs: DataFrame) -> DataFrame:
    """Per book what the statement's printed prices say of the fund that it was resolved to: matched, mismatched and unavailable rows, the worst deviation in percent.

    A row without a printed price says nothing; a day without a price of ours is unavailable, not a disagreement.
    """
    own = navs.select("scheme_id", F.col("nav_date").alias("txn_date"), F.col("nav").alias("__own"))
    printed = rows.select(*BOOK, "txn_date", "printed_nav").filter(F.col("printed_nav") > 0).join(own, ["scheme_id", "txn_date"], "left")
    off = F.when(F.col("__own") > 0, F.abs(F.col("printed_nav") - F.col("__own")).cast("double") / F.col("__own").cast("double") * 100.0)
    return printed.withColumn("off", off).groupBy(*BOOK).agg(
        F.count_if(F.col("off") <= PRICE_TOLERANCE_PCT).alias("matched"), F.count_if(F.col("off") > PRICE_TOLERANCE_PCT).alias("mismatched"), F.count_if(F.col("off").isNull()).alias("unavailable"), F.coalesce(F.max("off"), F.lit(0.0)).alias("worst_pct"),
    )


def reconcile_books(held: DataFrame, rows: DataFrame, navs: DataFrame, as_of: Column) -> DataFrame:
    """Per book of ``rows`` (reversals dropped; units_balance and printed_nav as printed): status, confidence and probable causes.

    The units of ``held`` (book, units; none: 0) are compared with the balance that the last row on or before ``as_of`` prints, and the
    printed prices with ``navs``. Without a balance, or without a price to compare, the book is a warning: not checked is not right.
    Fewer units than printed point to an earlier statement unless the first row shows that the book began with it.
    """
    place, balance = F.struct(*ORDER), F.col("units_balance")
    facts = rows.groupBy(*BOOK).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max_by(F.when(F.col("txn_date") <= as_of, balance), F.when((F.col("txn_date") <= as_of) & balance.isNotNull(), place)).alias("printed"),
        F.min_by(F.struct(balance.alias("balance"), "units"), F.when(F.col("units").isNotNull(), place)).alias("first"),
    )
    began = navs.groupBy("scheme_id").agg(F.min("nav_date").alias("first_price"))
    joined = facts.join(held.select(*BOOK, F.col("units").alias("computed")), BOOK, "left").join(price_witness(rows, navs), BOOK, "left").join(began, "scheme_id", "left")
    joined = joined.withColumn("computed", F.coalesce(F.col("computed").cast("decimal(24,6)"), F.lit(0).cast("decimal(24,6)"))).fillna(0, ["matched", "mismatched", "unavailable"]).fillna(0.0, ["worst_pct"])
    delta, printed = F.col("computed") - F.col("printed"), F.col("printed")
    share = F.when((F.col("first_price") <= as_of) & (printed > 0), F.abs(delta).cast("double") / printed.cast("double")).otherwise(0.0)
    units_off, prices_off = F.abs(delta) > F.lit(str(UNIT_TOLERANCE)).cast("decimal(10,6)"), F.col("mismatched") > 0
    off = units_off | (share > VALUE_TOLERANCE)
    unverified = (F.col("matched") + F.col("mismatched")) == 0
    from_zero = F.abs("first.balance") == F.abs("first.units")
    # Names of the probable causes.
    causes = F.array_compact(F.array(
        F.when(off & (delta < 0) & ~F.coalesce(from_zero, F.lit(False)), "MISSING_EARLY_CAS"), F.when(off & (delta >= 0), "MISSING_REDEMPTION"),
        F.when(off & (F.abs(delta).cast("double") < DRIFT_UNITS) & (F.col("n_rows") > DRIFT_ROWS), "FLOAT_CONTAMINATION"),
    ))
    causes = F.when(off & (F.size(causes) == 0), F.array(F.lit("UNKNOWN"))).otherwise(causes)
    causes = F.concat(causes, F.array_compact(F.array(F.when(prices_off, "WRONG_NAV_SERIES"), F.when(prices_off & ~units_off, "LIKELY_PLAN_MISMATCH_DIRECT_VS_REGULAR"))))
    failed = off | prices_off
    status = F.when(printed.isNull() | (~failed & unverified), "warn").when(failed, "fail").otherwise("ok")
    confidence = F.when(status == "ok", "high").when(status == "warn", "medium").otherwise("low")
    said = F.when(printed.isNull(), F.array(F.lit("NO_REPORTED_BALANCE"))).when(failed, causes).when(unverified, F.array(F.lit("NAV_SERIES_UNVERIFIED"))).otherwise(F.array().cast("array<string>"))
    return joined.select(*BOOK, "computed", "printed", delta.alias("delta"), status.alias("status"), confidence.alias("confidence"), said.alias("diagnosis"), "matched", "mismatched", "unavailable", "worst_pct")
