"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

A source's weight is a piecewise-linear schedule over training time 0..1. Its integral gives the source's
share of all demand; capped shares are filled up like water over the others. A document starts at the words
its source has given before it, and the inverse of the source's cumulative demand turns that into a training
position, by which documents are range-sorted.

Defined cases
    * null or empty text has size 0 and is taken 0 words; a null source is a source like any other, ordered last;
    * sources without words have target 0; documents of one id are told apart by size and checksum, so reruns agree;
    * documents without id are dealt by their text's checksum;
    * empty table: empty result; extra columns are ignored by the plan and kept by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navloom.llm.common import WORD_RE, text_or_empty

Schedule = Sequence[tuple[float, float]]

#: Weights 5, 2, 1 over the whole training, the first falling and the others rising.
FALLING_5_2_1: tuple[Schedule, ...] = (((0.0, 6.0), (1.0, 4.0)), ((0.0, 1.5), (1.0, 2.5)), ((0.0, 0.5), (1.0, 1.5)))


def schedule_area(knots: Schedule) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD_RE)).cast("long")


def _key(id_col: str, text_col: str) -> list[Column]:
    """The order of documents in their source: ``key`` (hex) and ``tie``."""
    tie = F.crc32(text_or_empty(text_col))
    return [F.md5(F.coalesce(F.col(id_col).cast("string"), tie.cast("string"))).alias("key"), tie.alias("tie")]


def _by_rank(values: Sequence[Column], rank: Column) -> Column:
    return F.element_at(F.array(*values), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, schedules: Sequence[Schedule], share: float, cap: int) -> DataFrame:
    """From (source, source_size): also rank, weight and target. One narrow row per source goes through one window.

    Sources fill up in the order of cap to weight. Where the level that all remaining sources could share is
    beyond a source's cap, its cap is its target; the first level below fixes all others.
    """
    areas = [schedule_area(s) for s in schedules]
    everything = Window.partitionBy(F.lit(1))
    ranked = sizes.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", _by_rank([F.lit(float(a)) for a in areas], F.col("rank")))
    ranked = ranked.withColumn("cap", F.col("source_size") * cap)
    filling = everything.orderBy(F.col("cap") / F.col("weight"), "rank")
    levels = ranked.withColumn(
        "level",
        (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        / F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)),
    ).withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return levels.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))).select("source", "source_size", "rank", "weight", "target")


def position_of(part: Column, segments: Column) -> Column:
    """The time at which a schedule's integral reaches ``part`` (0..1) of its whole."""
    last = F.element_at(segments, -1)
    area = part * (last["before"] + last["area"])
    inside = F.element_at(F.filter(segments, lambda s: (area <= s["before"] + s["area"]) | (s["t0"] == last["t0"])), 1)
    y = F.greatest(area - inside["before"], F.lit(0.0)) / inside["dt"]
    root = inside["w0"] + F.sqrt(F.greatest(inside["w0"] * inside["w0"] + 2 * (inside["w1"] - inside["w0"]) * y, F.lit(0.0)))
    return inside["t0"] + inside["dt"] * F.when(root > 0, 2 * y / root).otherwise(F.lit(0.0))


def _segments(knots: Schedule) -> Column:
    before, out = 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        area = (t1 - t0) * (w0 + w1) / 2
        out.append(F.struct(*(F.lit(float(v)).alias(k) for k, v in (("t0", t0), ("dt", t1 - t0), ("w0", w0), ("w1", w1), ("before", before), ("area", area)))))
        before += area
    return F.array(*out)


def _planned(rows: DataFrame, schedules: Sequence[Schedule], share: float, cap: int, digits: int, cut: bool) -> DataFrame:
    """``rows`` has source, size, key (hex) and tie columns; adds the plan's columns.

    Cumulative words per source come in two levels, so that no source is ever sorted in one task: totals of
    ``16 ** digits`` key ranges per source, then an order within each range.
    """
    # A key without nulls, so that the join and the window after it share one exchange.
    rows = rows.withColumn("range", F.substring("key", 1, digits)).withColumn("named", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    ranges = rows.groupBy("named", "source", "range").agg(F.sum("size").alias("range_size"))
    ordered = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("range_before", F.coalesce(F.sum("range_size").over(ordered), F.lit(0)))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), schedules, share, cap)
    ranges = ranges.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    joined = rows.join(ranges.select("named", "range", "range_before", "source_size", "rank", "target"), ["named", "range"])
    within = Window.partitionBy("named", "range").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("range_before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    demand = F.floor(F.col("target") + 0.5)
    turns = F.when(F.col("source_size") > 0, F.floor(demand / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0)).cast("long")
    over = F.col("demand") - F.col("turns") * F.col("source_size")
    more = F.greatest(F.lit(0), F.least(F.col("size"), over - F.col("before"))) if cut else F.when(F.col("before") * 2 + F.col("size") <= over * 2, F.col("size")).otherwise(F.lit(0))
    planned = joined.withColumn("before", before.cast("long")).withColumn("demand", demand.cast("long")).withColumn("turns", turns)
    planned = planned.withColumn("taken", (F.col("size") * F.col("turns") + more).cast("long"))
    return planned.withColumn("segments", _by_rank([_segments(s) for s in schedules], F.col("rank")))


def mix_plan(docs: DataFrame, schedules: Sequence[Schedule] = FALLING_5_2_1, share: float = 1.5, cap: int = 2, digits: int = 3, cut: bool = True, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, position; range-sorted by position.

    ``schedules`` repeat over the sources in code-point order. With ``cut`` the last document of a source
    gives only the words still wanted; without it a document is taken whole or not, whichever is nearer.
    ``position`` is the training time (0..1) of a document's first word, null if nothing is taken.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), *_key(id_col, text_col))
    planned = _planned(rows, schedules, share, cap, digits, cut)
    position = F.when(F.col("taken") > 0, position_of(F.least(F.col("before") / F.greatest(F.col("demand"), F.lit(1)), F.lit(1.0)), F.col("segments")))
    out = planned.select("doc_id", "size", "source_size", "target", "taken", "source", position.alias("position"))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def mixed_documents(docs: DataFrame, schedules: Sequence[Schedule] = FALLING_5_2_1, share: float = 1.5, cap: int = 2, digits: int = 3) -> DataFrame:
    """The rows of ``docs`` in training order, each as often as the mix takes it, with all their columns."""
    # Documents ride along to the window of their range: they are shuffled for it and for their order, and copied nowhere.
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    rows = docs.select("doc_id", "source", word_count("text").alias("size"), *_key("doc_id", "text"), whole)
    copies = F.explode(F.sequence(F.lit(0), (F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("long") - 1)).alias("turn")
    planned = _planned(rows, schedules, share, cap, digits, cut=False).filter("taken > 0").select("*", copies)
    part = (F.col("turn") * F.col("source_size") + F.col("before")) / F.greatest(F.col("demand"), F.lit(1))
    placed = planned.select("doc_id", "whole", position_of(F.least(part, F.lit(1.0)), F.col("segments")).alias("place"))
    return placed.repartitionByRange("place", "doc_id").sortWithinPartitions("place", "doc_id").select("whole.*")
