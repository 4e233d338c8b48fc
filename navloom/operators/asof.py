"""Lookups in time: latest at or before a date, first at or after it, nearest in either direction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_on_or_before(asks: DataFrame, facts: DataFrame, keys: list[str], ask_date: str, fact_date: str, values: list[str], max_age_days: int | None = None) -> DataFrame:
    """``asks`` with ``fact_date`` and ``values`` of the newest fact of its key that is not after ``ask_date``; null if there is none.

    Both sides go into one window, so a key is shuffled once and no pair of dates is ever joined. A fact counts
    on its own date. ``max_age_days`` drops facts that are older.
    """
    left = asks.select(*keys, F.col(ask_date).alias("__at"), F.lit(1).alias("__ask"), F.struct(*asks.columns).alias("__row"), F.lit(None).alias("__fact"))
    right = facts.select(*keys, F.col(fact_date).alias("__at"), F.lit(0).alias("__ask"), F.lit(None).alias("__row"), F.struct(fact_date, *values).alias("__fact"))
    order = Window.partitionBy(*keys).orderBy("__at", "__ask").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("__fact", F.last("__fact", ignorenulls=True).over(order)).filter("__ask = 1")
    if max_age_days is not None:
        both = both.withColumn("__fact", F.when(F.datediff("__at", F.col(f"__fact.{fact_date}")) <= max_age_days, F.col("__fact")))
    return both.select("__row.*", *(F.col(f"__fact.{c}").alias(c) for c in (fact_date, *values)))


def first_on_or_after(asks: DataFrame, facts: DataFrame, keys: list[str], ask_date: str, fact_date: str, values: list[str]) -> DataFrame:
    """The same, forward in time."""
    left = asks.select(*keys, F.col(ask_date).alias("__at"), F.lit(0).alias("__fact_row"), F.struct(*asks.columns).alias("__row"), F.lit(None).alias("__fact"))
    right = facts.select(*keys, F.col(fact_date).alias("__at"), F.lit(1).alias("__fact_row"), F.lit(None).alias("__row"), F.struct(fact_date, *values).alias("__fact"))
    order = Window.partitionBy(*keys).orderBy("__at", "__fact_row").rowsBetween(0, Window.unboundedFollowing)
    both = left.unionByName(right).withColumn("__fact", F.first("__fact", ignorenulls=True).over(order)).filter("__fact_row = 0")
    return both.select("__row.*", *(F.col(f"__fact.{c}").alias(c) for c in (fact_date, *values)))


def nearest(asks: DataFrame, facts: DataFrame, keys: list[str], ask_date: str, fact_date: str, values: list[str], max_days: int) -> DataFrame:
    """The nearest fact in either direction, the earlier on a tie, within ``max_days``; null otherwise."""
    before = latest_on_or_before(asks, facts, keys, ask_date, fact_date, values)
    after_names = {c: f"__after_{c}" for c in (fact_date, *values)}
    renamed = facts.select(*keys, *(F.col(c).alias(n) for c, n in after_names.items()))
    both = first_on_or_after(before, renamed, keys, ask_date, after_names[fact_date], [after_names[v] for v in values])
    back, ahead = F.datediff(ask_date, fact_date), F.datediff(after_names[fact_date], ask_date)
    use_back = back.isNotNull() & (ahead.isNull() | (back <= ahead))
    within = F.when(use_back, back).otherwise(ahead) <= max_days
    chosen = {c: F.when(within & use_back, F.col(c)).when(within, F.col(after_names[c])) for c in (fact_date, *values)}
    return both.withColumns(chosen).drop(*after_names.values())
