"""Fund statistics over return windows, against a benchmark, and among peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navloom.operators.nav import annualised

# Trading days a year, paired observations a benchmark figure needs, days by which a window may fall short, peers a rank needs.
TRADING_DAYS = 252.0
MIN_PAIRED = 20
SLACK_DAYS = 7
MIN_PEERS = 5
WINDOWS = {"1y": 1, "3y": 3, "5y": 5, "since_first_nav": None}


def _root() -> Column:
    return F.sqrt(F.lit(TRADING_DAYS))


def risk(returns: DataFrame, by: list[str], mar: float = 0.0) -> DataFrame:
    """Annualised volatility (0 for one return) and downside deviation, which divides by all returns."""
    short = F.least(F.col("ret") - mar, F.lit(0.0))
    return returns.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_returns"), (F.coalesce(F.stddev_samp("ret"), F.lit(0.0)) * _root()).alias("volatility"), (F.sqrt(F.sum(short * short) / F.count(F.lit(1))) * _root()).alias("downside")
    )


def ratio(excess: Column, by: Column) -> Column:
    """Null unless the divisor is positive."""
    return F.when(by > 0, excess / by)


def in_windows(navs: DataFrame, as_of: DataFrame | None = None) -> DataFrame:
    """Each price once per window it belongs to. A window starts N years before the series' last price, on the 28th for a 29 February."""
    last = F.max("nav_date").over(Window.partitionBy("scheme_id"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("window"), F.lit(y).cast("int").alias("years")) for k, y in WINDOWS.items()))).alias("w")
    spread = navs.withColumn("as_of", last).select("*", each).select(*navs.columns, "as_of", "w.window", "w.years")
    start = F.when(F.col("years").isNull(), F.lit(None).cast("date")).otherwise(F.add_months("as_of", F.col("years") * -12))
    return spread.withColumn("start", start).filter("start is null or nav_date >= start")


def confidence(days: Column) -> Column:
    return F.when(days >= 1095, "high").when(days >= 365, "medium").otherwise("low")


def return_windows(navs: DataFrame) -> DataFrame:
    """Per fund and window: dates, growth, annual return, whether the prices span the window, and confidence."""
    rows = in_windows(navs)
    found = rows.groupBy("scheme_id", "window", "years").agg(
        F.min("nav_date").alias("from_date"), F.max("nav_date").alias("to_date"), F.count(F.lit(1)).alias("n_obs"), F.countDistinct("nav").alias("different"),
        F.min_by("nav", "nav_date").alias("first_nav"), F.max_by("nav", "nav_date").alias("last_nav"),
    )
    days = F.datediff("to_date", "from_date")
    kept = found.withColumn("days", days).filter("n_obs >= 2 and different >= 2 and days > 0")
    growth = F.col("last_nav") / F.col("first_nav")
    spans = F.when(F.col("years").isNull(), True).otherwise(F.col("days") + SLACK_DAYS >= F.col("years") * 365)
    return kept.select("scheme_id", "window", "from_date", "to_date", "days", "n_obs", (growth - 1).alias("ret"), annualised(growth, F.col("days")).alias("ret_annual"), spans.alias("spans"), confidence(F.col("days")).alias("confidence"))


def window_risk(navs: DataFrame, risk_free_pct: float = 6.0) -> DataFrame:
    """Per fund and window: volatility, downside, Sharpe and Sortino ratios."""
    order = Window.partitionBy("scheme_id", "window").orderBy("nav_date")
    rows = in_windows(navs).withColumn("ret", F.col("nav") / F.lag("nav").over(order) - 1).filter("ret is not null")
    figures = risk(rows, ["scheme_id", "window"])
    joined = return_windows(navs).select("scheme_id", "window", "ret_annual").join(figures, ["scheme_id", "window"])
    excess = F.col("ret_annual") - risk_free_pct / 100
    return joined.withColumn("sharpe", ratio(excess, F.col("volatility"))).withColumn("sortino", ratio(excess, F.col("downside")))


def paired(navs: DataFrame, levels: DataFrame) -> DataFrame:
    """Returns of fund and benchmark between dates that both have."""
    joined = navs.join(levels, navs["nav_date"] == levels["level_date"]).drop("level_date")
    order = Window.partitionBy("scheme_id").orderBy("nav_date")
    return joined.withColumn("f", F.col("nav") / F.lag("nav").over(order) - 1).withColumn("b", F.col("level") / F.lag("level").over(order) - 1).filter("f is not null")


def against_benchmark(navs: DataFrame, levels: DataFrame, risk_free_pct: float = 6.0) -> DataFrame:
    """Per fund over all paired returns: beta, tracking error, alpha, Treynor and information ratios, up and down capture."""
    pairs = paired(navs, levels)
    variance = F.var_samp("b")
    capture = lambda on: (F.exp(F.sum(F.when(on, F.log(1 + F.col("f"))))) - 1) / (F.exp(F.sum(F.when(on, F.log(1 + F.col("b"))))) - 1)
    ends = navs.join(levels, navs["nav_date"] == levels["level_date"]).groupBy("scheme_id").agg(
        F.datediff(F.max("nav_date"), F.min("nav_date")).alias("days"), (F.max_by("nav", "nav_date") / F.min_by("nav", "nav_date")).alias("fg"), (F.max_by("level", "nav_date") / F.min_by("level", "nav_date")).alias("bg")
    )
    stats = pairs.groupBy("scheme_id").agg(
        F.count(F.lit(1)).alias("n_paired"), F.when(variance > 0, F.covar_samp("f", "b") / variance).alias("beta"), (F.stddev_samp(F.col("f") - F.col("b")) * _root()).alias("tracking_error"),
        capture(F.col("b") > 0).alias("up_capture"), capture(F.col("b") < 0).alias("down_capture"),
    )
    out = stats.filter(F.col("n_paired") >= MIN_PAIRED).join(ends, "scheme_id").withColumn("ra", annualised(F.col("fg"), F.col("days"))).withColumn("rb", annualised(F.col("bg"), F.col("days")))
    rf = risk_free_pct / 100
    return out.select(
        "scheme_id", "n_paired", "beta", "tracking_error", (F.col("ra") - (rf + F.col("beta") * (F.col("rb") - rf))).alias("alpha"), ratio(F.col("ra") - rf, F.col("beta")).alias("treynor"),
        ratio(F.col("ra") - F.col("rb"), F.col("tracking_error")).alias("information_ratio"), "up_capture", "down_capture",
    )


def peer_ranks(figures: DataFrame, by: list[str], metric: str, higher_is_better: bool = True) -> DataFrame:
    """Competition rank (1, 2, 2, 4), quartile, and the group's range; null ranks in groups of fewer than five."""
    group = Window.partitionBy(*by)
    known = figures.filter(F.col(metric).isNotNull())
    n = F.count(F.lit(1)).over(group)
    rank = F.rank().over(group.orderBy(F.desc(metric) if higher_is_better else F.asc(metric)))
    enough = n >= MIN_PEERS
    return known.select(
        "*", n.alias("n_peers"), F.when(enough, rank).alias("peer_rank"), F.when(enough, F.ceil(4 * rank / n).cast("int")).alias("quartile"), F.min(metric).over(group).alias("peer_low"), F.max(metric).over(group).alias("peer_high")
    )


def leaders(figures: DataFrame, by: str, metric: str, k: int = 5) -> DataFrame:
    group = Window.partitionBy(by)
    return figures.filter(F.col(metric).isNotNull()).withColumn("place", F.row_number().over(group.orderBy(F.desc(metric), "scheme_id"))).withColumn("members", F.count(F.lit(1)).over(group)).filter(F.col("place") <= k)


def live_funds(funds: DataFrame, seen: DataFrame, within_days: int = 7) -> DataFrame:
    """Direct plans seen within ``within_days`` of the newest date: one per house and family, growth first, then by id. A fund without a family stands alone."""
    dated = funds.join(seen.groupBy("scheme_id").agg(F.max("nav_date").alias("last_seen")), "scheme_id")
    newest = F.broadcast(dated.agg(F.max("last_seen").alias("newest")))
    live = dated.crossJoin(newest).filter(F.datediff("newest", "last_seen") <= within_days)
    # Two parts of the key, so that no family's name meets a fund's id.
    alone = F.when(F.col("family").isNull(), F.col("scheme_id"))
    growth = F.coalesce(F.col("option") == "growth", F.lit(False))
    rank = F.row_number().over(Window.partitionBy("amc_id", "family", alone).orderBy(F.desc(growth), "scheme_id"))
    return live.filter("plan = 'direct'").withColumn("rank", rank).filter("rank = 1").drop("rank", "newest")
