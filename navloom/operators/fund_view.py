"""What a fund's page shows: measures by window beside the benchmark's, the strip of key figures, and where a fund lies among its peers.

A group is one fund, or one fund and window: as many rows as the fund has prices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navloom.functions.shown import DASH, date_text, return_text
from navloom.functions.text import ordinal
from navloom.operators.fund import WINDOWS, in_windows, return_windows, window_risk
from navloom.operators.nav import annualised

YEAR = 365
# What the windows are called, and the wording of the strip.
LABELS = {"1y": "1 year", "3y": "3 years", "5y": "5 years"}
NOT_ON_RECORD = "Not on record"


def window_falls(navs: DataFrame) -> DataFrame:
    """Per fund and window the deepest fall from a high within it: depth (0 if it never fell), peak, trough, and days from the trough until that high was reached again, null if it was not.

    Of equally deep falls the first counts. The peak is the first day of its price.
    """
    each = Window.partitionBy("scheme_id", "window").orderBy("nav_date")
    high = F.max(F.struct("nav", (-F.unix_date("nav_date")).alias("less"))).over(each.rowsBetween(Window.unboundedPreceding, 0))
    rows = in_windows(navs).select("scheme_id", "window", "nav_date", "nav").withColumn("high", high).withColumn("depth", F.col("nav") / F.col("high.nav") - 1)
    worst = rows.groupBy("scheme_id", "window").agg(F.min(F.struct("depth", "nav_date", "high")).alias("w"))
    worst = worst.select("scheme_id", "window", "w.depth", F.col("w.nav_date").alias("trough"), F.col("w.high.nav").alias("level"), F.date_from_unix_date(-F.col("w.high.less")).alias("peak"))
    back = rows.select("scheme_id", "window", "nav_date", "nav").join(worst, ["scheme_id", "window"]).filter("depth < 0 and nav_date > trough and nav >= level").groupBy("scheme_id", "window").agg(F.min("nav_date").alias("back"))
    fell = F.col("depth") < 0
    return worst.join(back, ["scheme_id", "window"], "left").select("scheme_id", "window", "depth", F.when(fell, F.col("peak")).alias("peak"), F.when(fell, F.col("trough")).alias("trough"), F.datediff("back", "trough").alias("recovery_days"))


def window_benchmark(navs: DataFrame, levels: DataFrame) -> DataFrame:
    """Per fund and window the benchmark's yearly return between the first and the last day that both have; null within one day."""
    both = in_windows(navs).join(levels, F.col("nav_date") == F.col("level_date")).groupBy("scheme_id", "window")
    ends = both.agg(F.datediff(F.max("nav_date"), F.min("nav_date")).alias("days"), (F.max_by("level", "nav_date") / F.min_by("level", "nav_date")).alias("growth"))
    return ends.select("scheme_id", "window", F.when(F.col("days") > 0, annualised(F.col("growth"), F.col("days"))).alias("bench_annual"))


def measures(navs: DataFrame, levels: DataFrame) -> DataFrame:
    """(scheme_id, window, measure, value): one row per measure of each window that the prices span; ``lead`` is null without a benchmark."""
    keys = ["scheme_id", "window"]
    wide = return_windows(navs).filter("spans").select(*keys, "ret_annual").join(window_risk(navs).select(*keys, "volatility", "sharpe", "sortino"), keys, "left")
    wide = wide.join(window_benchmark(navs, levels), keys, "left").join(window_falls(navs).select(*keys, F.col("depth").alias("max_dd")), keys, "left").withColumn("lead", F.col("ret_annual") - F.col("bench_annual"))
    return wide.unpivot(keys, ["ret_annual", "bench_annual", "lead", "volatility", "max_dd", "sharpe", "sortino"], "measure", "value")


def rank_words(rank: Column, ranked: Column, reason: Column) -> Column:
    """``7th of 34``, or why there is no rank."""
    return F.when(rank.isNull(), F.coalesce(reason, F.lit(DASH))).otherwise(F.concat(ordinal(rank), F.lit(" of "), ranked.cast("string")))


def range_place(value: Column, low: Column, high: Column) -> Column:
    """Where a value lies between the lowest and highest of its group, 0 to 100; in the middle where all are equal."""
    return F.when(high == low, 50.0).otherwise(F.least(F.greatest((value - low) * 100.0 / (high - low), F.lit(0.0)), F.lit(100.0)))


def header_strip(funds: DataFrame, navs: DataFrame, levels: DataFrame, ranks: DataFrame) -> DataFrame:
    """The strip of a fund's key figures: (scheme_id, place, tile, value, context, tone), each fund with all tiles that apply.

    ``funds`` has scheme_id, aum, aum_as_of, ter and ter_as_of; ``ranks`` scheme_id, peer_rank and n_peers. Returns over one, three and five
    years, each beside the benchmark's and null where the prices don't span the window; the rank; the worst fall of a fund with a year of
    prices, if it fell; volatility over three years, else over one; size and yearly cost.
    """
    keys = ["scheme_id", "window"]
    stats = return_windows(navs).select(*keys, "spans", "days", "ret_annual").join(window_benchmark(navs, levels), keys, "left")
    stats = stats.join(window_risk(navs).select(*keys, "volatility"), keys, "left").join(window_falls(navs), keys, "left")
    figure = F.struct("spans", "days", "ret_annual", "bench_annual", "volatility", "depth", "peak", "trough", "recovery_days")
    by_fund = stats.groupBy("scheme_id").agg(*(F.max(F.when(F.col("window") == w, figure)).alias(f"w_{w}") for w in WINDOWS))
    wide = funds.join(by_fund, "scheme_id", "left").join(ranks.select("scheme_id", "peer_rank", "n_peers"), "scheme_id", "left")
    nothing = F.lit(None)

    def tile(place: int, name: str, value: Column, context: Column, tone: Column = nothing) -> Column:
        return F.struct(F.lit(place).alias("place"), F.lit(name).alias("tile"), value.cast("double").alias("value"), context.cast("string").alias("context"), tone.cast("string").alias("tone"))

    def spanned(w: str) -> Column:
        return F.coalesce(F.col(f"w_{w}.spans"), F.lit(False))

    def returned(place: int, w: str) -> Column:
        value, bench, known = F.col(f"w_{w}.ret_annual"), F.col(f"w_{w}.bench_annual"), spanned(w)
        tone = F.when(known & bench.isNotNull(), F.when(value > bench, "ahead").otherwise("behind"))
        beside = F.when(bench.isNotNull(), F.concat(F.when(value > bench, "Ahead of").otherwise("Behind"), F.lit(" its benchmark, "), return_text(bench, F.lit(True))))
        return tile(place, f"return_{w}", F.when(known, value), F.when(known, beside).otherwise(f"Less than {LABELS[w]} of prices on record"), tone)

    whole = lambda c: F.col(f"w_since_first_nav.{c}")
    after = F.when(whole("recovery_days").isNotNull(), F.concat(F.lit("back at its high "), F.format_number(whole("recovery_days"), 0), F.lit(" days after the low"))).otherwise("not yet back at that high")
    fall = F.when((whole("days") >= YEAR) & (whole("depth") < 0), tile(5, "worst_fall", whole("depth"), F.concat(date_text(whole("peak")), F.lit(" to "), date_text(whole("trough")), F.lit("; "), after)))
    steady = F.coalesce(*(F.when(spanned(w), tile(6, "volatility", F.col(f"w_{w}.volatility"), F.lit(f"Annualised, from {LABELS[w]} of daily prices"))) for w in ("3y", "1y")))
    ranked = tile(4, "rank", F.col("peer_rank"), rank_words(F.col("peer_rank"), F.col("n_peers"), nothing.cast("string")))
    size = tile(7, "fund_size", F.col("aum"), F.when(F.col("aum").isNotNull(), F.concat(F.lit("Quarterly average to "), date_text(F.col("aum_as_of")))).otherwise(NOT_ON_RECORD))
    cost = tile(8, "ter", F.col("ter"), F.when(F.col("ter").isNotNull(), F.concat(F.lit("Total, a year; "), date_text(F.col("ter_as_of")))).otherwise(NOT_ON_RECORD))
    tiles = F.array_compact(F.array(returned(1, "1y"), returned(2, "3y"), returned(3, "5y"), ranked, fall, steady, size, cost))
    return wide.select("scheme_id", F.explode(tiles).alias("t")).select("scheme_id", "t.*")
