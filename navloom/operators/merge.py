"""How new rows meet stored ones: later wins, only missing ones, revisions, spans that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_wins(stored: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union of both, one row per key: the one with the highest ``order``, the new one on a tie."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("__new")))
    return both.withColumn("__rank", rank).filter("__rank = 1").drop("__rank", "__new")


def where_absent(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows, and new ones only for keys that have none."""
    return stored.unionByName(new.join(stored.select(*keys), keys, "left_anti").dropDuplicates(keys))


def seen_spans(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """first_seen never moves forward, last_seen never back."""
    return stored.unionByName(new).groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def current_revision(revisions: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the newest revision of each key. "Current" is derived, so appending a revision rewrites nothing."""
    return revisions.withColumn("newest", F.max("revision").over(Window.partitionBy(*keys))).filter("revision = newest").drop("newest")


def next_revisions(stored: DataFrame, new: DataFrame, keys: list[str], identity: list[str]) -> DataFrame:
    """New rows that differ in ``identity`` from their key's current revision, with the next number. Reading the same again adds nothing."""
    current = stored.groupBy(*keys).agg(F.max("revision").alias("newest"), F.max_by(F.struct(*identity), "revision").alias("same"))
    joined = new.join(current, keys, "left").filter(~F.struct(*identity).eqNullSafe(F.col("same")))
    return joined.withColumn("revision", F.coalesce("newest", F.lit(0)) + 1).drop("newest", "same")


def changed_only(stored: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Updates of known keys whose value is new and not null."""
    old = stored.select(*keys, F.col(value).alias("old"))
    return new.join(old, keys).filter(F.col(value).isNotNull() & ~F.col(value).eqNullSafe(F.col("old"))).drop("old")


def collisions(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys that stand for more than one combination of ``fields``."""
    return rows.groupBy(key).agg(F.countDistinct(F.struct(*fields)).alias("different")).filter("different > 1")


def in_force(rates: DataFrame, keys: list[str], on) -> DataFrame:
    """Per key the newest rate valid at ``on``, at its latest revision."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("valid_from"), F.desc("revision")))
    return rates.filter(F.col("valid_from") <= on).withColumn("rank", rank).filter("rank = 1").drop("rank")


def last_of_month(rows: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """Per key and month the value on its last day; dropped if that day has different ones."""
    month = F.trunc(date, "month")
    last = rows.withColumn("month", month).withColumn("last", F.max(date).over(Window.partitionBy(*keys, month))).filter(F.col(date) == F.col("last"))
    return last.groupBy(*keys, "month").agg(F.max(date).alias(date), F.min(value).alias(value), F.countDistinct(value).alias("n")).filter("n = 1").drop("n")
