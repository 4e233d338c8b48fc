"""Which price histories are worth asking for again, and in which pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navloom.functions.shown import GAP_DAYS, short_reason

# Days in which a missed day is looked for, and for which an answer is trusted to have been all there was.
RECENT_DAYS, TRUSTED_DAYS = 31, 30


def year_chunks(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """Each range cut at calendar years: chunk_start and chunk_end for every year that it touches, so that later runs ask for the same pieces. A range that ends before it starts is an error; one without an end or a start has no pieces."""
    a, b = F.col(start), F.col(end)
    years = F.when(b < a, F.raise_error(F.concat(F.lit("range ends before it starts: "), a.cast("string"), F.lit(" to "), b.cast("string"))).cast("array<int>")).otherwise(F.sequence(F.year(a), F.year(b)))
    spread = ranges.withColumn("__year", F.explode(years))
    first, last = F.make_date("__year", F.lit(1), F.lit(1)), F.make_date("__year", F.lit(12), F.lit(31))
    return spread.withColumn("chunk_start", F.greatest(a, first)).withColumn("chunk_end", F.least(b, last)).drop("__year")


def short_histories(schemes: DataFrame, navs: DataFrame, today: Column) -> DataFrame:
    """(scheme_id, reason) of the schemes (scheme_id, inception, fetched) whose history is short and worth asking for.

    A scheme asked for within ``TRUSTED_DAYS`` lacks what its source lacks and is left alone, unless days are missing from its last month. Without any
    price at all every scheme is asked for. One window per fund and one row of the newest day, which a single aggregate gives.
    """
    seen = navs.groupBy("scheme_id").agg(F.min("nav_date").alias("first"), F.max("nav_date").alias("last"), F.count("nav_date").alias("rows"))
    known = schemes.select("scheme_id", "inception", "fetched").join(seen, "scheme_id", "left")
    newest = F.broadcast(known.agg(F.max("last").alias("newest")))
    recent = navs.join(schemes.select("scheme_id"), "scheme_id", "left_semi").crossJoin(newest).filter(F.col("nav_date") >= F.date_sub("newest", RECENT_DAYS))
    step = F.datediff("nav_date", F.lag("nav_date").over(Window.partitionBy("scheme_id").orderBy("nav_date")))
    gaps = recent.select("scheme_id", step.alias("step")).groupBy("scheme_id").agg(F.max("step").alias("gap"))
    both = known.join(gaps, "scheme_id", "left").crossJoin(newest).withColumn("gap", F.coalesce("gap", F.lit(0)))
    reason = F.when(F.col("newest").isNull(), "no prices").otherwise(short_reason(F.col("first"), F.col("last"), F.coalesce("rows", F.lit(0)), F.col("gap"), F.col("inception"), F.col("newest")))
    trusted = F.coalesce(F.datediff(today, "fetched") < TRUSTED_DAYS, F.lit(False)) & (F.col("gap") <= GAP_DAYS) & F.col("newest").isNotNull()
    return both.withColumn("reason", reason).filter(F.col("reason").isNotNull() & ~trusted).select("scheme_id", "reason")
