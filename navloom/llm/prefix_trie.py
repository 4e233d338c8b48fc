"""The trie of shared beginnings of conversations, from the Cartesian tree over sorted conversations.

Turns are hashed (role and text, 128 bits). Equal sequences of turns become one row, and rows are range-sorted, so that a
partition is a block of neighbours. ``lcp`` is how many turns a row shares with the row before. A node of the trie is the
run of rows that share its turns, and it is named by the first of them and its depth: row ``l`` brings in the depths above
its ``lcp`` up to its length, and the run of depth ``d`` ends before the first later row whose ``lcp`` is below ``d``.
These are all-nearest-smaller-values questions. Within a block they are answered by pointers over the block; what runs out
of a block finds the block where it ends by the blocks' minima, and the row there by that block's prefix minima (suffix
minima for the nearest smaller row before, which names the parent). Rows of one run with the same ``lcp`` are children of
one node, so equal values merge; the depths between two nodes are expanded from one segment; and every figure of a node
is a difference of prefix sums, or a minimum carried along the pointers.

Blocks are as many as the sort has partitions, so their minima and sums (a few numbers each) are held by every task. A
conversation's hashes, 16 bytes a turn, make one row. Lists of members are digested in pieces, one in memory at a time.

Defined cases
    * null role or text counts as empty; turns are ordered by turn (null first), then role, then text;
    * rows without conv_id belong to no conversation and are left out; repeated rows are turns like any other;
    * turnless conversations are members of the root; equal conversations share their nodes;
    * empty table: empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navloom.llm.common import cut_lineage, heavy_keys, salted_join, small_batches, text_or_empty

#: Members whose ids are joined to one piece of a list.
IDS_IN_PIECE = 10_000
NO_MEMBERS = hashlib.sha256().hexdigest()
TOP = 1 << 62


def hashed_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, token, bytes): turns in order from 1, without their texts.

    Rows are ranged by conversation and turn and counted by range, so a conversation of any size is dealt over many tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places, tokens, sizes = [], [], []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                at = at + 1 if conv == now else 1
                now = conv
                data = text.encode("utf-8")
                places.append(at)
                tokens.append(hashlib.blake2b(f"{len(role)} {role} ".encode() + data, digest_size=16).digest())
                sizes.append(len(data))
            kinds = [pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64()), pa.array(tokens, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *kinds], ["conv_id", "part", "at", "token", "bytes"])

    small_batches(rows.sparkSession)
    clean = rows.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    counted = cut_lineage(clean.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "conv_id long, part int, at long, token binary, bytes long"))
    # Only the first and the last conversation of a range go on in another one: two rows a range at most.
    split = counted.groupBy("conv_id", "part").agg(F.max("at").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    split = split.withColumn("before", F.sum("n").over(earlier)).filter("before is not null").select("conv_id", "part", "before")
    return counted.join(F.broadcast(split), ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("place"), "token", "bytes")


def borrowed_turns(conv: Column) -> Column:
    # Fixed value: how many turns a conversation takes over from the first of its five.
    return F.crc32(conv.cast("string").cast("binary")) % 9


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, source, place, token, bytes): every conversation with its borrowed turns (source 0) before its own (1); one row without token each as well."""
    conv = F.col("conv_id")
    own = turns.filter(F.col("place") > borrowed_turns(conv)).select(conv, F.lit(1).alias("source"), "place", "token", "bytes")
    first = turns.filter((conv % 5 == 0) & (F.col("place") <= 8)).select(conv.alias("base"), "place", "token", "bytes")
    # Before 0 the remainder is negative, so the five are the base and those before it.
    lent = first.select("*", F.explode(F.sequence(F.col("base") - 4, F.col("base") + 4)).alias("conv_id")).filter((conv - conv % 5 == F.col("base")) & (F.col("place") <= borrowed_turns(conv)))
    every = cut_lineage(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id"))
    lent = lent.join(every, "conv_id", "left_semi").select("conv_id", F.lit(0).alias("source"), "place", "token", "bytes")
    mark = every.select("conv_id", F.lit(0).alias("source"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("token"), F.lit(None).cast("long").alias("bytes"))
    return own.unionByName(lent).unionByName(mark)


def as_they_are(turns: DataFrame) -> DataFrame:
    """The conversations of ``turns`` unchanged, in the form of ``rebuilt``."""
    return turns.select("conv_id", F.lit(1).alias("source"), "place", "token", "bytes")


def _members(sequences: DataFrame) -> DataFrame:
    """(key, ends_sha256) of rows (key, conv_id): the digest of all ids of a key, ascending."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            cuts = [a for begin, end in zip(cuts, cuts[1:]) for a in range(begin, end, IDS_IN_PIECE)] + [len(keys)]
            runs = [slice(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]
            yield pa.RecordBatch.from_arrays([pa.array([keys[r.start] for r in runs], pa.string()), pa.array([ids[r.start] for r in runs], pa.int64()), pa.array([",".join(map(str, ids[r])) for r in runs], pa.string())], ["key", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key == now:
                    state.update(b"," + ids.encode())
                else:
                    if now is not None:
                        out.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["key", "ends_sha256"])
            out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    ranged = sequences.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(pieces, "key string, first long, ids string")
    return ranged.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digests, "key string, ends_sha256 string")


def _sorted_rows(classes: DataFrame) -> DataFrame:
    """Classes in the order of their tokens: part, at, the class's columns, lcp and inside (the row before is its beginning).

    Both are null for the first row of a part, whose tokens are kept; a row without ``at`` keeps a part's last tokens.
    """
    names = ["part", "at", "conv_id", "n_convs", "length", "lcp", "inside", "reach", "ends_sha256", "tokens"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.list_(pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            out = []
            for conv, n, tokens, sizes, ends in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                reach = [0, *np.cumsum(sizes, dtype=np.int64).tolist()]
                if last is None:
                    shared = None
                else:
                    shared = next((i for i, (x, y) in enumerate(zip(last, tokens)) if x != y), len(last))  # the shorter comes first
                out.append((part, at, conv, n, len(tokens), shared, None if shared is None else int(shared == len(last)), reach, ends, tokens if at == 0 else None))
                last, at = tokens, at + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
        if last is not None:
            end = (part, None, None, None, len(last), None, None, None, None, last)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(end, kinds, strict=True)], names)

    ranged = classes.select("conv_id", "n_convs", "tokens", "sizes", "ends_sha256").repartitionByRange("tokens").sortWithinPartitions("tokens")
    return ranged.mapInArrow(run, "part int, at long, conv_id long, n_convs long, length long, lcp long, inside long, reach array<long>, ends_sha256 string, tokens array<binary>")


def _joined_blocks(rows: DataFrame) -> DataFrame:
    """The sorted rows with the numbers of each part's first row set from the last row of the part before."""
    ends = rows.filter("tokens is not null").groupBy("part").agg(
        F.max(F.when(F.col("at") == 0, F.col("tokens"))).alias("first"), F.max(F.when(F.col("at").isNull(), F.col("tokens"))).alias("last")
    )
    # One row a part.
    ends = ends.withColumn("before", F.lag("last").over(Window.orderBy("part")))
    differs = F.array_position(F.zip_with("before", "first", lambda x, y: x.eqNullSafe(y)), False) - 1
    ends = ends.select("part", F.coalesce(differs, F.lit(-1)).cast("long").alias("first_lcp"), F.coalesce((differs == F.size("before")).cast("long"), F.lit(0).cast("long")).alias("first_inside"))
    whole = rows.filter("at is not null").drop("tokens").join(F.broadcast(ends), "part")
    whole = whole.withColumn("lcp", F.coalesce("lcp", "first_lcp")).withColumn("inside", F.coalesce("inside", "first_inside")).drop("first_lcp", "first_inside")
    total = F.element_at("reach", -1)
    return whole.withColumn("weighed", F.col("n_convs") * total).withColumn("fresh", total - F.element_at("reach", (F.greatest("lcp", F.lit(0)) + 1).cast("int")))


class Blocks:
    """What every task knows of the blocks, in order: where they begin, sums before them, minima, and the next block with a smaller minimum."""

    SUMS = ("n_convs", "inside", "weighed", "fresh")

    def __init__(self, rows: DataFrame) -> None:
        sums = [F.sum(c).alias(c) for c in self.SUMS]
        found = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("lcp").alias("least"), F.min("conv_id").alias("conv_id"), *sums).orderBy("part").collect()
        self.number = {r["part"]: i for i, r in enumerate(found)}
        self.least, self.conv = [r["least"] for r in found], [r["conv_id"] for r in found]
        self.begin = np.cumsum([0, *(r["n"] for r in found)]).tolist()
        self.sums = {c: np.cumsum([0, *(r[c] for r in found)]).tolist() for c in self.SUMS}
        self.after, self.span = next_smaller(self.least, self.conv)

    def totals(self) -> tuple[int, ...]:
        return (self.begin[-1], *(self.sums[c][-1] for c in self.SUMS))


def next_smaller(values: list[int], payload: list[int]) -> tuple[list[int], list[int]]:
    """For each place the next one with a smaller value (the length if none), and the smallest payload from here to before it."""
    n = len(values)
    after, span = [n] * n, [0] * n
    for i in range(n - 1, -1, -1):
        j, least = i + 1, payload[i]
        while j < n and values[j] >= values[i]:
            least, j = min(least, span[j]), after[j]
        after[i], span[i] = j, least
    return after, span


def last_smaller(values: list[int]) -> list[int]:
    """For each place the last one before it with a smaller value, or -1."""
    out: list[int] = []
    for i, v in enumerate(values):
        j = i - 1
        while j >= 0 and values[j] >= v:
            j = out[j]
        out.append(j)
    return out


SEGMENT, OPEN, PREFIX, SUFFIX = range(4)
_FIELDS = "kind int, block int, l long, lcp long, lo long, hi long, k long, n_convs long, inside long, weighed long, fresh long, conv_id long, left long, l_convs long, l_inside long, l_weighed long, l_fresh long, total long, length long, ends_sha256 string, before array<long>"
_NAMES = [f.split(" ")[0] for f in _FIELDS.split(", ")]
_KINDS = [pa.int32() if f.endswith(" int") else pa.string() if f.endswith("string") else pa.list_(pa.int64()) if f.endswith(">") else pa.int64() for f in _FIELDS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], _NAMES)


def _block_segments(block: int, blocks: Blocks, lcp: list[int], columns: dict[str, list[Any]]) -> list[tuple]:
    """Segments of the rows of one block, those that run out of it, and its prefix and suffix minima."""
    n, g = len(lcp), blocks.begin[block]
    sums = [(np.cumsum([0, *columns[c]]) + blocks.sums[c][block]).tolist() for c in Blocks.SUMS]
    at = [tuple(s[i] for s in sums) for i in range(n + 1)]
    after, span = next_smaller(lcp, columns["conv_id"])
    left = last_smaller(lcp)
    out: list[tuple] = []
    for i in range(n):
        reach, length = columns["reach"][i], columns["length"][i]
        # The nearest smaller of 0 is the first row of all.
        parent = None if lcp[i] < 0 else 0 if lcp[i] == 0 else g + left[i] if left[i] >= 0 else None
        convs, inside, weighed, fresh = at[i]
        mine = (parent, convs, inside + columns["inside"][i], weighed, fresh + columns["fresh"][i], reach[-1], length, columns["ends_sha256"][i])
        hi, k, least = length, i + 1, columns["conv_id"][i]
        while hi > lcp[i]:
            if k < n and lcp[k] >= hi:
                least, k = min(least, span[k]), after[k]
                continue
            lo = max(lcp[i], lcp[k]) if k < n else lcp[i]
            before = [reach[max(d - 1, 0)] for d in range(lo + 1, hi + 1)]
            if k < n:
                out.append((SEGMENT, block, g + i, lcp[i], lo, hi, g + k, *at[k], least, *mine, before))
            else:
                out.append((OPEN, block, g + i, lcp[i], lo, hi, None, None, None, None, None, least, *mine, before))
            hi = lo
    least, value = None, TOP
    for i in range(n):
        if lcp[i] < value:
            out.append((PREFIX, block, None, None, lcp[i], value, g + i, *at[i], least, *[None] * 9))
            value = lcp[i]
        least = columns["conv_id"][i] if least is None else min(least, columns["conv_id"][i])
    value = TOP
    for i in range(n - 1, -1, -1):
        if lcp[i] < value:
            out.append((SUFFIX, block, None, None, lcp[i], value, g + i, *[None] * 14))
            value = lcp[i]
    return out


def _in_blocks(rows: DataFrame, blocks: Any) -> DataFrame:
    names = ["conv_id", "n_convs", "inside", "weighed", "fresh", "length", "reach", "ends_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, lcp, columns = None, [], {c: [] for c in names}
        for batch in batches:
            parts = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    if part is not None and parts[a] != part:
                        yield _batch(_block_segments(blocks.value.number[part], blocks.value, lcp, columns))
                        lcp, columns = [], {c: [] for c in names}
                    part = int(parts[a])
                    lcp += batch.column(1).slice(a, b - a).to_pylist()
                    for i, c in enumerate(names):
                        columns[c] += batch.column(i + 2).slice(a, b - a).to_pylist()
        if part is not None:
            yield _batch(_block_segments(blocks.value.number[part], blocks.value, lcp, columns))

    return rows.repartition("part").sortWithinPartitions("part", "at").select("part", "lcp", *names).mapInArrow(run, _FIELDS)


def _across_blocks(found: DataFrame, blocks: Any) -> DataFrame:
    """The segments that run out of their block, cut where they end: by the blocks' minima, then by the prefix minima of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = blocks.value
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                lo, hi, least, k = row["lo"], row["hi"], row["conv_id"], row["block"] + 1
                while hi > lo:
                    if k < len(b.least) and b.least[k] >= hi:
                        least, k = min(least, b.span[k]), b.after[k]
                        continue
                    to = max(lo, b.least[k]) if k < len(b.least) else lo
                    before = row["before"][to - lo : hi - lo]
                    changes = {"lo": to, "hi": hi, "conv_id": least, "before": before, "block": k, "kind": OPEN}
                    if k == len(b.least):
                        changes |= dict(zip(("k", *Blocks.SUMS), b.totals(), strict=True)) | {"kind": SEGMENT}
                    out.append(tuple((row | changes)[c] for c in _NAMES))
                    hi = to
            yield _batch(out)

    pieces = cut_lineage(found.filter(F.col("kind") == OPEN).mapInArrow(run, _FIELDS))
    ends = found.filter(F.col("kind") == PREFIX).select("block", F.col("lo").alias("value"), F.col("hi").alias("above"), *(F.col(c).alias(f"end_{c}") for c in ("k", *Blocks.SUMS, "conv_id")))
    cut = pieces.filter(F.col("kind") == OPEN).join(ends, "block").filter("greatest(lo, value) < least(hi, above)")
    cut = cut.withColumn("to", F.greatest("lo", "value")).withColumn("from", F.least("hi", "above"))
    cut = cut.withColumn("before", F.slice("before", (F.col("to") - F.col("lo") + 1).cast("int"), (F.col("from") - F.col("to")).cast("int")))
    changes = {"lo": F.col("to"), "hi": F.col("from"), "conv_id": F.least("conv_id", "end_conv_id"), "kind": F.lit(SEGMENT)} | {c: F.col(f"end_{c}") for c in ("k", *Blocks.SUMS)}
    cut = cut.withColumns(changes).select(*_NAMES)
    return pieces.filter(F.col("kind") == SEGMENT).unionByName(cut)


def _earlier_rows(found: DataFrame, firsts: DataFrame, blocks: Any) -> DataFrame:
    """(block, lcp, left): the last row before a block whose lcp is smaller, for values that have none in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = blocks.value.least
        before = last_smaller(least)
        for batch in batches:
            out = []
            for block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                j = block - 1
                while least[j] >= value:  # the first row of all is smaller than any
                    j = before[j]
                out.append((block, value, j))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.int32()))], ["block", "lcp", "target"])

    asked = firsts.filter("left is null").select("block", "lcp").distinct().mapInArrow(run, "block int, lcp long, target int")
    rows = found.filter(F.col("kind") == SUFFIX).select(F.col("block").alias("target"), F.col("lo").alias("value"), "k")
    return asked.join(rows, "target").filter("value < lcp").groupBy("block", "lcp").agg(F.max("k").alias("earlier"))


def prefix_nodes(sequences: DataFrame) -> DataFrame:
    """The trie of rows (conv_id, source, place, token, bytes; token null: no turn), one row per node:
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = sequences.sparkSession
    turn = F.when(F.col("token").isNotNull(), F.struct("source", "place", "token", "bytes"))
    whole = sequences.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = whole.select("conv_id", F.transform("turns", lambda t: t["token"]).alias("tokens"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"))
    whole = cut_lineage(whole.withColumn("key", F.sha2(F.concat_ws("", F.transform("tokens", lambda t: F.hex(t))), 256)))
    classes = whole.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min(F.struct("tokens", "sizes")).alias("s"))
    classes = classes.join(_members(whole), "key").select("conv_id", "n_convs", "s.tokens", "s.sizes", "ends_sha256")
    rows = cut_lineage(_joined_blocks(cut_lineage(_sorted_rows(classes))))
    blocks = spark.sparkContext.broadcast(Blocks(rows))
    found = cut_lineage(_in_blocks(rows, blocks))
    segments = found.filter(F.col("kind") == SEGMENT).unionByName(_across_blocks(found, blocks))
    # A segment that starts at its row's own lcp hangs on the node that the nearest smaller row brings in.
    own = F.col("lo") == F.col("lcp")
    segments = cut_lineage(segments.withColumn("first", own).withColumn("below", F.lag("conv_id").over(Window.partitionBy("l").orderBy("lo"))))
    # Pieces of open segments have left their block; ``found`` knows the block of their row.
    firsts = found.filter(F.col("kind").isin(SEGMENT, OPEN) & own & (F.col("lcp") >= 0)).select("l", "block", "lcp", "left")
    firsts = firsts.join(_earlier_rows(found, firsts, blocks), ["block", "lcp"], "left")
    firsts = cut_lineage(firsts.select("l", F.coalesce("left", "earlier").alias("up"), F.col("lcp").alias("depth")))
    nodes = segments.select(F.col("l").alias("up"), F.col("hi").alias("depth"), F.col("conv_id").alias("parent"))
    parents = salted_join(firsts, nodes, ["up", "depth"], ["l"], heavy_keys(firsts, ["up", "depth"])).select("l", F.lit(True).alias("first"), "parent")
    forks = firsts.groupBy(F.col("up").alias("l"), F.col("depth").alias("hi")).agg(F.count(F.lit(1)).alias("forks"))
    all_segments = segments.join(parents, ["l", "first"], "left").join(forks, ["l", "hi"], "left")
    convs = F.col("n_convs") - F.col("l_convs")
    leaves = F.col("k") - F.col("l") - (F.col("inside") - F.col("l_inside"))
    opened = all_segments.select("*", F.posexplode("before").alias("step", "earlier"), convs.alias("members"), leaves.alias("leaves"))
    depth = F.col("lo") + 1 + F.col("step")
    saved = F.col("weighed") - F.col("l_weighed") - F.col("members") * F.col("earlier") - (F.col("fresh") - F.col("l_fresh")) - (F.col("total") - F.col("earlier"))
    goes_on = (F.col("length") > F.col("hi")).cast("long")
    return opened.select(
        "conv_id", depth.alias("depth"),
        F.when(F.col("step") > 0, F.col("conv_id")).otherwise(F.coalesce("parent", "below")).alias("parent_conv_id"),
        F.col("members").alias("n_convs"),
        F.when(depth < F.col("hi"), F.lit(1).cast("long")).otherwise(F.coalesce("forks", F.lit(0).cast("long")) + goes_on).alias("n_children"),
        F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"),
        F.when(depth == F.col("length"), F.col("ends_sha256")).otherwise(F.lit(NO_MEMBERS)).alias("ends_sha256"),
    )


def conversation_trie(rows: DataFrame, borrow: bool = True) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turn, role, text); with ``borrow`` they are rebuilt first."""
    turns = cut_lineage(hashed_turns(rows))
    return prefix_nodes(rebuilt(turns) if borrow else as_they_are(turns))
