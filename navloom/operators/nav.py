"""Price series: splits, payouts, sibling series, returns, drawdowns, rolling windows, growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navloom.operators.asof import first_on_or_after, latest_on_or_before

# Jumps taken for a change of unit, and how near to one a move must be.
SPLIT_FACTORS = (100, 10)
SPLIT_TOLERANCE = 0.1


def _series(key: str = "scheme_id", date: str = "nav_date") -> Window:
    return Window.partitionBy(key).orderBy(date)


def split_exponent(ratio):
    """The power of ten that a move stands for: 2, 1, -1, -2, or 0 for an ordinary move."""
    out = F.lit(0)
    for factor in SPLIT_FACTORS:
        power = len(str(factor)) - 1
        out = F.when(F.abs(ratio / factor - 1) <= SPLIT_TOLERANCE, power).when(F.abs(ratio * factor - 1) <= SPLIT_TOLERANCE, -power).otherwise(out)
    return out


def rescale_splits(navs: DataFrame) -> DataFrame:
    """Bring each series to its newest unit: earlier prices times all later jumps. Exponents add, so nothing drifts."""
    power = split_exponent(F.col("nav") / F.lag("nav").over(_series()))
    later = Window.partitionBy("scheme_id").orderBy("nav_date").rowsBetween(1, Window.unboundedFollowing)
    marked = navs.withColumn("power", F.coalesce(power, F.lit(0)))
    total = F.coalesce(F.sum("power").over(later), F.lit(0))
    return marked.withColumn("nav_rescaled", F.round(F.col("nav") * F.pow(F.lit(10.0), total), 6)).withColumn("n_splits", F.count_if(F.col("power") != 0).over(Window.partitionBy("scheme_id"))).drop("power")


def adjust_payouts(navs: DataFrame, payouts: DataFrame) -> DataFrame:
    """Reinvest payouts: from a payout day on, prices times before / (before - amount), where before > amount > 0."""
    joined = navs.join(payouts, ["scheme_id", "nav_date"], "left")
    before = F.lag("nav").over(_series())
    factor = F.when((F.col("amount") > 0) & (before > F.col("amount")), F.log(before / (before - F.col("amount")))).otherwise(0.0)
    marked = joined.withColumn("log_factor", F.coalesce(factor, F.lit(0.0)))
    grown = F.exp(F.sum("log_factor").over(_series().rowsBetween(Window.unboundedPreceding, 0)))
    return marked.withColumn("nav_adj", F.round(F.col("nav") * grown, 6)).drop("log_factor")


def adjust_by_sibling(navs: DataFrame, siblings: DataFrame) -> DataFrame:
    """A payout share class moves like its growth sibling: first own price times the sibling's growth since then.

    ``siblings`` has (scheme_id, sibling_id). The sibling's price is the newest known on each date.
    """
    asks = navs.join(siblings, "scheme_id")
    prices = navs.select(F.col("scheme_id").alias("sibling_id"), F.col("nav_date").alias("sibling_date"), F.col("nav").alias("sibling_nav"))
    known = latest_on_or_before(asks, prices, ["sibling_id"], "nav_date", "sibling_date", ["sibling_nav"])
    anchor = Window.partitionBy("scheme_id").orderBy("nav_date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.when(F.col("sibling_nav").isNotNull(), F.struct("nav", "sibling_nav")), ignorenulls=True).over(anchor)
    return known.withColumn("nav_adj", F.round(first["nav"] * F.col("sibling_nav") / first["sibling_nav"], 6))


def growth_siblings(schemes: DataFrame, navs: DataFrame) -> DataFrame:
    """(scheme_id, sibling_id) of payout classes (scheme_id, family, plan, option): the priced growth class of their family, of their own plan if it has one, the smallest id of several. Schemes without a family have none.

    The candidates are one row per family and plan, so that no pairs are made within a family.
    """
    priced = schemes.filter("option = 'growth' and family is not null").join(navs.filter("nav is not null").select("scheme_id").distinct(), "scheme_id", "left_semi").withColumn("plan", F.coalesce("plan", F.lit("")))
    per_plan = priced.groupBy("family", "plan").agg(F.min("scheme_id").alias("same"))
    per_family = per_plan.groupBy("family").agg(F.min("same").alias("other"))
    asking = schemes.filter("option like 'idcw%' and family is not null").select("scheme_id", "family", F.coalesce("plan", F.lit("")).alias("plan"))
    return asking.join(per_plan, ["family", "plan"], "left").join(per_family, "family").select("scheme_id", F.coalesce("same", "other").alias("sibling_id"))


def adjusted_prices(navs: DataFrame, payouts: DataFrame, schemes: DataFrame) -> DataFrame:
    """Every price (scheme_id, nav_date, nav) with ``nav_adj``, what it is worth with all payouts reinvested, and ``basis``, where that comes from.

    Changes of unit go first, for siblings as well. A fund with payouts on record is chained by them; one without takes the growth of its
    sibling from the first day that both have (before it: its own price); any other keeps its own. Null prices go. All funds are done at once,
    each in windows of its own prices.
    """
    own = rescale_splits(navs.filter("nav is not null").select("scheme_id", "nav_date", "nav")).select("scheme_id", "nav_date", F.col("nav_rescaled").alias("nav"))
    declared = payouts.select("scheme_id").distinct()
    siblings = growth_siblings(schemes, navs).join(declared, "scheme_id", "left_anti")
    chained = adjust_payouts(own.join(siblings.select("scheme_id"), "scheme_id", "left_anti"), payouts.select("scheme_id", "nav_date", "amount"))
    chained = chained.join(declared.withColumn("declared", F.lit("payouts")), "scheme_id", "left").select("scheme_id", "nav_date", "nav", "nav_adj", F.coalesce("declared", F.lit("own")).alias("basis"))
    followed = adjust_by_sibling(own, siblings).select("scheme_id", "nav_date", "nav", F.coalesce("nav_adj", F.round("nav", 6)).alias("nav_adj"), F.when(F.col("nav_adj").isNull(), "own").otherwise("sibling").alias("basis"))
    return chained.unionByName(followed)


def daily_returns(navs: DataFrame) -> DataFrame:
    return navs.withColumn("ret", F.col("nav") / F.lag("nav").over(_series()) - 1).filter("ret is not null")


def with_drawdown(navs: DataFrame) -> DataFrame:
    """Peak so far, its first date, and the fall from it."""
    so_far = _series().rowsBetween(Window.unboundedPreceding, 0)
    peaked = navs.withColumn("peak", F.max("nav").over(so_far))
    new = F.when((F.col("nav") == F.col("peak")) & (F.col("peak") > F.coalesce(F.max("nav").over(_series().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))), F.col("nav_date"))
    return peaked.withColumn("peak_date", F.last(new, ignorenulls=True).over(so_far)).withColumn("drawdown", F.round(F.col("nav") / F.col("peak") - 1, 6))


def max_drawdown(navs: DataFrame) -> DataFrame:
    """Per series: the deepest fall (the earliest of equals), its peak, its trough, and the first day back at the peak's price."""
    falls = with_drawdown(navs)
    exact = F.col("nav") / F.col("peak") - 1
    worst = falls.groupBy("scheme_id").agg(F.min(F.struct(exact.alias("depth"), F.col("nav_date").alias("trough_date"), "peak_date", "peak")).alias("w")).filter("w.depth < 0")
    flat = worst.select("scheme_id", "w.depth", "w.peak_date", "w.trough_date", "w.peak")
    back = navs.join(flat, "scheme_id").filter("nav_date > trough_date and nav >= peak").groupBy("scheme_id").agg(F.min("nav_date").alias("recovery_date"))
    out = flat.join(back, "scheme_id", "left")
    return out.select("scheme_id", F.round("depth", 6).alias("depth"), "peak_date", "trough_date", "recovery_date", F.datediff("trough_date", "peak_date").alias("fall_days"), F.datediff("recovery_date", "trough_date").alias("recovery_days"))


def annualised(growth, days):
    return F.when((days > 0) & (growth > 0), F.exp(F.log(growth) * 365.0 / days) - 1)


def rolling_windows(navs: DataFrame, horizon_days: int, step_days: int) -> DataFrame:
    """Windows that start every ``step_days`` from the first price on: first price at or after the start, last at or before its end.

    Growth is annualised by the horizon, not by the days between the two prices found.
    """
    span = navs.groupBy("scheme_id").agg(F.min("nav_date").alias("d0"), F.max("nav_date").alias("dn")).filter(F.date_sub("dn", horizon_days) >= F.col("d0"))
    starts = span.select("scheme_id", F.explode(F.sequence("d0", F.date_sub("dn", horizon_days), F.expr(f"interval {step_days} days"))).alias("start"))
    asks = starts.withColumn("stop", F.date_add("start", horizon_days))
    opened = first_on_or_after(asks, navs.select("scheme_id", F.col("nav_date").alias("from_date"), F.col("nav").alias("from_nav")), ["scheme_id"], "start", "from_date", ["from_nav"])
    closed = latest_on_or_before(opened, navs.select("scheme_id", F.col("nav_date").alias("to_date"), F.col("nav").alias("to_nav")), ["scheme_id"], "stop", "to_date", ["to_nav"])
    kept = closed.filter("from_date < to_date")
    return kept.withColumn("ret", annualised(F.col("to_nav") / F.col("from_nav"), F.lit(float(horizon_days))))


def rolling_summary(windows: DataFrame, least: int = 12) -> DataFrame:
    """Per series: worst, median, best and share of positive windows; null with fewer than ``least``."""
    enough = F.count(F.lit(1)) >= least
    return windows.groupBy("scheme_id").agg(
        F.count(F.lit(1)).alias("n_windows"), F.when(enough, F.min("ret")).alias("worst"), F.when(enough, F.median("ret")).alias("median"), F.when(enough, F.max("ret")).alias("best"),
        F.when(enough, F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)) * 100.0).alias("positive_pct"),
    )


def growth_of(navs: DataFrame, amount: float = 10_000.0) -> DataFrame:
    first = F.first("nav").over(_series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return navs.withColumn("value", F.round(amount * F.col("nav") / first, 2))


def latest_change(navs: DataFrame) -> DataFrame:
    """Per series: its last price and the change from the one before. Prices marked ``is_interpolated`` don't count."""
    navs = navs.filter(~F.col("is_interpolated")).drop("is_interpolated") if "is_interpolated" in navs.columns else navs
    rank = F.row_number().over(Window.partitionBy("scheme_id").orderBy(F.desc("nav_date")))
    before = F.lag("nav").over(_series())
    return navs.withColumn("before", before).withColumn("rank", rank).filter("rank = 1").select("scheme_id", "nav_date", "nav", F.round(F.col("nav") - F.col("before"), 6).alias("change"), F.round((F.col("nav") / F.col("before") - 1) * 100.0, 6).alias("change_pct"))


def gaps(navs: DataFrame, over_days: int) -> DataFrame:
    """Stretches of more than ``over_days`` without a price."""
    return navs.withColumn("from_date", F.lag("nav_date").over(_series())).withColumn("days", F.datediff("nav_date", "from_date")).filter(F.col("days") > over_days).select("scheme_id", "from_date", F.col("nav_date").alias("to_date"), "days")


def coverage(navs: DataFrame) -> DataFrame:
    """Per series: first and last date, number of prices, longest stretch between two."""
    days = F.datediff("nav_date", F.lag("nav_date").over(_series()))
    return navs.withColumn("days", days).groupBy("scheme_id").agg(F.min("nav_date").alias("first_date"), F.max("nav_date").alias("last_date"), F.count(F.lit(1)).alias("n_prices"), F.max("days").alias("longest_gap"))
