"""N-gram Jaccard join with set-relation skipping: exact components of all links at or above a threshold.

Equal sets are one set. Most sets of a group of near copies share minhashes with the group's most central set; that
is their *centre*. Each set is measured against its centre once, and what it lacks of the centre's shingles and has
beyond them is kept. Centres only steer the work: every link is verified, and none is lost.

* index-level skipping: prefixes of the sets (rarest shingles first) form inverted lists cut into blocks, one per
  token and cluster, that hold the block's size range and earliest position. A set skips a block when position or
  sizes rule out the overlap that a link needs; it meets the others' centres, never their members.
* answer-level skipping: a set's overlap with all members of a cluster is derived from the centre's: two sets
  share what the centre has, less what either lacks, and what both have beyond it. So members' texts never meet, and
  only short lists of differing shingles are read. A set whose distance from the centre rules out every member
  (Jaccard distance is a metric) stops there. Sets linked to the centre are not compared with each other.

Of two clusters that meet, the smaller one's sets visit the larger, so a lone set meets a group of any size as one row.
Inside a cluster, lists of differing shingles are compared in blocks of bounded size, each pair of blocks a group.

Defined cases
    * null text, empty text and text without words: the empty set, which links with nothing and is its own component;
    * rows with equal sets (repeated rows included) always share a component; a null id counts as the largest id;
    * one very large group of copies is one set; a large cluster is verified in blocks of bounded size;
    * empty table: empty result; only the id and text columns are read, so other columns' names don't matter.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.llm.bloom import marked
from navloom.llm.common import cut_lineage, drop_tables, fresh, heavy_keys, mark_tables, salted_join, small_batches, written_once
from navloom.llm.components import connected_components
from navloom.llm.shingles import mix, shared_with, shingle_sets

MINHASHES = 8
#: Shingles are counted in this many cells, whatever the corpus holds; the counts order the prefixes.
COUNT_CELLS = 1 << 18
#: Shingles of a set are counted by hash in so many cells of one byte; what two sets share is at most the sum of the lesser counts.
PROFILE_CELLS = 128
#: Differing shingles that one block of a cluster holds.
BLOCK_SHINGLES = 1_000_000
#: A set joins the cluster of a centre that is at most this many per cent below the threshold.
SLACK = 40

_SEEDS = mix(np.arange(1, MINHASHES + 3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids and texts with row numbers that no later job can assign anew."""
    return written_once(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "numbered")


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _profile(s: np.ndarray) -> bytes | None:
    """How many shingles fall in each cell; none where a count is too large for a byte."""
    counts = np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=PROFILE_CELLS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def sketches(rows: DataFrame, words: int) -> DataFrame:
    """Per row: n (size of the set), two halves of a fingerprint of the set, its minhashes and its profile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, one, two, least, profile = [], [], [], [], []
            for s in shingle_sets(batch.column(2), words):
                size.append(len(s))
                one.append(_signed(np.add.reduce(mix(s ^ _SEEDS[-1]), keepdims=True))[0] if len(s) else 0)
                two.append(_signed(np.bitwise_xor.reduce(mix(s ^ _SEEDS[-2]), keepdims=True))[0] if len(s) else 0)
                least.append(_signed(np.array([mix(s ^ seed).min() for seed in _SEEDS[:MINHASHES]], np.uint64)) if len(s) else None)
                profile.append(_profile(s))
            columns = [batch.column(0), batch.column(1), pa.array(size, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(least, pa.list_(pa.int64())), pa.array(profile, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n", "print1", "print2", "least", "profile"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, doc_id {kind}, n int, print1 long, print2 long, least array<long>, profile binary")


def shingle_counts(rows: DataFrame, words: int) -> np.ndarray:
    """How many sets hold a shingle of each cell: a vector of fixed size, summed by Spark in slices."""
    slices, width = 64, COUNT_CELLS // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNT_CELLS, np.int64)
        for batch in batches:
            for s in shingle_sets(batch.column(0), words):
                np.add.at(total, (s >> np.uint64(46)).astype(np.int64), 1)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([x.tobytes() for x in total.reshape(slices, width)], pa.binary())], ["slice", "counts"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in group["counts"])
        return pd.DataFrame({"slice": [group["slice"].iloc[0]], "counts": [total.tobytes()]})

    summed = rows.select("text").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInPandas(add, "slice int, counts binary")
    out = np.zeros((slices, width), np.int64)
    for r in summed.collect():
        out[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(-1)


def prefixes(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(row, n, tokens): the shingles of each set's prefix, rarest first. Two linked sets share one of them."""
    counts = rows.sparkSession.sparkContext.broadcast(shingle_counts(rows, words).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = counts.value
        for batch in batches:
            size, tokens = [], []
            for s in shingle_sets(batch.column(1), words):
                keep = len(s) - -(-len(s) * percent // 100) + 1 if len(s) else 0
                size.append(len(s))
                tokens.append(_signed(s[np.lexsort((s, order[(s >> np.uint64(46)).astype(np.int64)]))[:keep]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))], ["row", "n", "tokens"])

    return rows.select("row", "text").mapInArrow(run, "row long, n int, tokens array<long>")


def nearest_centres(sets: DataFrame) -> DataFrame:
    """(a, b): for a set ``a``, the set ``b`` that shares at least two, and most, of its minhashes among the central ones.

    A set is the more central the more sets share its minhashes; each minhash stands for the most central set that has it.
    """
    spread = sets.select("row", F.posexplode("least").alias("which", "value"))
    sharing = cut_lineage(spread.groupBy("which", "value").agg(F.count(F.lit(1)).alias("sharing")).filter("sharing > 1"))
    heavy = heavy_keys(sharing, ["which", "value"], F.col("sharing"))
    met = salted_join(spread, sharing, ["which", "value"], ["row"], heavy)
    central = cut_lineage(met.groupBy("row").agg(F.sum("sharing").alias("sharing"), F.collect_list(F.struct("which", "value")).alias("least")))
    spread = central.select("row", "sharing", F.explode("least").alias("at")).select("row", "sharing", "at.*")
    heads = spread.groupBy("which", "value").agg(F.max(F.struct("sharing", (-F.col("row")).alias("less"))).alias("head"))
    votes = salted_join(spread, heads, ["which", "value"], ["row"], heavy).filter("head.less <> -row").groupBy("row", "head").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.filter("votes > 1").groupBy("row").agg(F.max(F.struct("votes", "head")).alias("best"))
    return best.select(F.col("row").alias("a"), (-F.col("best.head.less")).alias("b"))


def differences(pairs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b, need, open): a, b, n (size of a), near (linked), far (Jaccard distance), lacks, differing, for those of at least ``need`` Jaccard.

    ``differing`` lists the ``lacks`` shingles of b that a lacks, then those that a has beyond b; only where ``open``.
    Only texts that occur in a pair are moved, and those of a set in many pairs are dealt over several tasks.
    """
    pairs = cut_lineage(pairs.select("a", "b", "need", "open"))
    keys = cut_lineage(pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row"))).distinct())
    texts = marked(rows.select("row", "text"), "row", keys, "maybe").filter("maybe").drop("maybe")
    with_a = salted_join(pairs, texts.select(F.col("row").alias("a"), F.col("text").alias("ta")), ["a"], ["b"])
    with_b = salted_join(with_a, texts.select(F.col("row").alias("b"), F.col("text").alias("tb")), ["b"], ["a"], heavy_keys(pairs, ["b"]))
    with_b = with_b.select("a", "b", "need", "open", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(rows: list[int], texts: pa.Array) -> Iterator[np.ndarray]:
            """The sets in order; a row met often, as a centre is, is worked out once."""
            new = [i for i, r in enumerate(rows) if r not in recent and (i == 0 or rows[i - 1] != r)]
            fresh_sets = dict(zip((rows[i] for i in new), shingle_sets(texts.take(pa.array(new, pa.int64())), words), strict=True))
            for r in rows:
                if r in fresh_sets:
                    recent[r] = fresh_sets[r]
                yield recent[r] if r in recent else fresh_sets[r]
            while len(recent) > 64:
                recent.popitem(last=False)

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                a, b, need, opened = (part.column(c).to_pylist() for c in range(4))
                out: list[tuple] = []
                for i, (x, y) in enumerate(zip(shingle_sets(part.column(4), words), of(b, part.column(5)), strict=True)):
                    shared = shared_with(x, y)
                    common = int(shared.sum())
                    union = len(x) + len(y) - common
                    if common < (need[i] - 1e-9) * union:
                        continue
                    lists = [y[~shared_with(y, x)], x[~shared]] if opened[i] else [x[:0]] * 2
                    out.append((a[i], b[i], opened[i], len(x), 100 * common >= percent * union, 1 - common / union, len(lists[0]), _signed(np.concatenate(lists))))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out) if out else [()] * 8, _DIFFERENCE_TYPES, strict=True)], _DIFFERENCE_NAMES)

    return with_b.mapInArrow(run, "a long, b long, open boolean, n int, near boolean, far double, lacks int, differing array<long>")


_DIFFERENCE_NAMES = ["a", "b", "open", "n", "near", "far", "lacks", "differing"]
_DIFFERENCE_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_(), pa.float64(), pa.int32(), pa.list_(pa.int64())]


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, need, open) that the sets' sizes and profiles don't rule out. No text is read for it."""
    pairs = cut_lineage(pairs.select("a", "b", "need", "open"))
    columns, heavy = pairs.columns, {k: heavy_keys(pairs, [k]) for k in "ab"}
    for k, other in ("ab", "ba"):
        pairs = salted_join(pairs, sets.select(F.col("row").alias(k), F.col("n").alias(f"n_{k}"), F.col("profile").alias(f"profile_{k}")), [k], [other], heavy[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = pc.and_(pc.is_valid(batch.column(6)), pc.is_valid(batch.column(7))).to_numpy(zero_copy_only=False)
            size = batch.column(4).to_numpy().astype(np.int64) + batch.column(5).to_numpy()
            need, keep = batch.column(2).to_numpy(), ~known
            for at in np.array_split(np.flatnonzero(known), max(1, known.sum() // 4096)):
                x, y = (np.frombuffer(b"".join(batch.column(c).take(pa.array(at)).to_pylist()), np.uint8).reshape(-1, PROFILE_CELLS) for c in (6, 7))
                most = np.minimum(x, y).sum(1, dtype=np.int64)
                keep[at] = most >= (need[at] - 1e-9) * (size[at] - most)
            yield pa.RecordBatch.from_arrays(batch.columns[:4], columns).filter(pa.array(keep))

    return pairs.select(*columns, "n_a", "n_b", "profile_a", "profile_b").mapInArrow(run, "a long, b long, need double, open boolean")


def links_inside(visits: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join up the sets measured against each centre, beyond those to the centre itself.

    ``visits`` has a, b (the centre), n, near, lacks and differing. Centres whose sets are all near need no
    work. Others are cut into blocks, and each pair of blocks is one group.
    """
    loose = visits.groupBy("b").agg(F.sum(F.size("differing") + 1).alias("shingles"), F.count(F.lit(1)).alias("all"), F.count_if(~F.col("near")).alias("loose"))
    loose = loose.filter("loose > 0 and all > 1").select("b", F.ceil(F.col("shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    heavy = heavy_keys(visits, ["b"])
    work = salted_join(visits, loose, ["b"], ["a"], heavy).withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    placed = work.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("a", "b", "n", "near", "lacks", "differing", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        ids, near, block, size, lacks = (group[c].to_numpy() for c in ("a", "near", "block", "n", "lacks"))
        across = group["left"].iloc[0] != group["right"].iloc[0]
        pairs = list(_joining_links(list(group["differing"]), lacks.astype(np.int64), size.astype(np.int64), near, block if across else None, percent))
        return pd.DataFrame({"a": ids[[x for x, _ in pairs]], "b": ids[[y for _, y in pairs]]}, dtype="int64")

    return placed.groupBy("b", "left", "right").applyInPandas(verify, "a long, b long")


def _joining_links(differing: list[np.ndarray], lacks: np.ndarray, size: np.ndarray, near: np.ndarray, block: np.ndarray | None, percent: int) -> Iterator[tuple[int, int]]:
    """Verified links that connect all that is connected, given that all ``near`` sets already are.

    Answers are derived from the centre's: two sets share what the centre has, less the shingles either lacks
    (those that both lack counted once), and the further shingles that both have. So only lists of differing shingles are read.
    """
    n = len(size)
    centre = int(size[0] + 2 * lacks[0] - len(differing[0]))
    tokens, at = np.unique(np.concatenate(differing), return_inverse=True)
    owner = np.repeat(np.arange(n), [len(d) for d in differing])
    by_token = owner[np.argsort(at, kind="stable")]
    bounds = np.searchsorted(np.sort(at), np.arange(len(tokens) + 1))
    ends = np.cumsum([len(d) for d in differing])
    group = np.where(near, -1, np.arange(n))
    for x in np.flatnonzero(~near):
        own = at[ends[x] - len(differing[x]) : ends[x]]
        lists = [by_token[bounds[t] : bounds[t + 1]] for t in own if bounds[t + 1] - bounds[t] > 1]
        both = np.bincount(np.concatenate(lists), minlength=n) if lists else np.zeros(n, np.int64)
        common = centre - lacks[x] - lacks + both
        hit = 100 * common >= percent * (size[x] + size - common)
        hit &= group != group[x]
        if block is not None:
            hit &= block != block[x]
        found = np.flatnonzero(hit)
        for g, y in {group[y]: y for y in found}.items():
            yield int(x), int(y)
            group[group == g] = group[x]


def visitors(tokens: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """(a, b): a set and the centre of another, larger cluster with members to which it may link, from the inverted lists of prefixes.

    ``clusters`` has row, centre and members (how many sets the centre's cluster holds).
    """
    posted = cut_lineage(tokens.join(clusters, "row")).select("row", "n", "centre", "members", F.posexplode("tokens").alias("at", "token"))
    several = cut_lineage(posted.groupBy("token").agg(F.min("centre").alias("low"), F.max("centre").alias("high"), F.count(F.lit(1)).alias("rows")).filter("low < high").select("token", "rows"))
    heavy, several = heavy_keys(several, ["token"], F.col("rows")), several.select("token")
    maybe = marked(posted, "token", several, "maybe").filter("maybe").drop("maybe")
    entries = cut_lineage(salted_join(maybe, several, ["token"], ["row"], heavy))
    blocks = entries.groupBy("token", F.col("centre").alias("b"), F.col("members").alias("b_members")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("at")).alias("left"))
    keep = f"""(b_members > members or b_members = members and b > centre)
        and 100L * high >= {percent}L * n and 100L * n >= {percent}L * low
        and {100 + percent}L * least(left, n - at) >= {percent}L * (low + n)"""
    return salted_join(entries, blocks, ["token"], ["row"], heavy).filter(keep).select(F.col("row").alias("a"), "b").distinct()


def set_links(rows: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between the rows that stand for the distinct sets: enough to connect all that is connected."""
    similar = F.lit((percent - SLACK) / 100)
    tried = nearest_centres(sets).select("a", "b", similar.alias("need"), F.lit(True).alias("open"))
    home = cut_lineage(differences(possible(tried, sets), rows, words, percent))
    reach = cut_lineage(home.groupBy(F.col("b").alias("centre")).agg(F.count(F.lit(1)).alias("members"), F.max("far").alias("reach")))
    heavy = heavy_keys(reach, ["centre"], F.col("members"))
    placed = home.select(F.col("a").alias("row"), F.col("b").alias("centre"))
    # The others are centres themselves, most of them of none but themselves.
    free = sets.select("row").join(placed, "row", "left_anti").join(reach.withColumnRenamed("centre", "row"), "row", "left").select("row", F.col("row").alias("centre"), F.coalesce("members", F.lit(0)).alias("members"))
    clusters = cut_lineage(free.union(salted_join(placed, reach, ["centre"], ["row"], heavy).select("row", "centre", "members")))
    met = visitors(prefixes(rows, words, percent), clusters, percent)
    # A visitor must be near enough to the centre for one of its members to be linked.
    need = F.lit(percent / 100) - F.coalesce("reach", F.lit(0.0))
    met = met.join(reach.withColumnRenamed("centre", "b"), "b", "left").select("a", "b", need.alias("need"), F.col("reach").isNotNull().alias("open"))
    guests = cut_lineage(differences(possible(met, sets), rows, words, percent))
    links = home.filter("near").select("a", "b").union(guests.filter("near").select("a", "b"))
    return links.union(links_inside(home.union(guests.filter("open")), percent))


def row_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: row (its number in ``docs``), doc_id, n_shingles, class_row (the row of its class that stands for all) and component_id."""
    return _components(_numbered(docs, id_col, text_col), words, percent)


def _components(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """``row_components`` of rows (row, doc_id, text) whose numbers are already fixed."""
    small_batches(rows.sparkSession)
    mark = mark_tables()
    found = cut_lineage(sketches(rows, words))
    prints = ["print1", "print2", "n"]
    # The row that stands for a set, and for a class, has its smallest id; ids that are null count as the largest.
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    sets = found.filter("n > 0").groupBy(*prints).agg(F.min(key).alias("leader"), F.any_value("least").alias("least"), F.any_value("profile").alias("profile"))
    sets = cut_lineage(sets.select(F.col("leader.row").alias("row"), "leader", *prints, "least", "profile"))
    components = connected_components(set_links(rows, sets.select("row", "n", "least", "profile"), words, percent))
    classes = sets.select("row", "leader", *prints).join(components.withColumnRenamed("node", "row"), "row", "left").withColumn("class", F.coalesce("component", "row")).drop("component", "row")
    classes = cut_lineage(classes)
    leaders = classes.groupBy("class").agg(F.min("leader").alias("first"))
    of_set = salted_join(classes, leaders, ["class"], ["print1"]).select(*prints, "first")
    some = salted_join(found.filter("n > 0").select("row", "doc_id", *prints), of_set, prints, ["row"])
    some = some.select("row", "doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("first.row").alias("class_row"), F.col("first.doc_id").alias("component_id"))
    none = found.filter("n = 0").select("row", "doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("row").alias("class_row"), F.col("doc_id").alias("component_id"))
    out = cut_lineage(some.unionByName(none))
    drop_tables(rows.sparkSession, mark, keep=1)
    return out


def near_duplicate_classes(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document: the smallest id reachable over links of at least ``percent`` % Jaccard."""
    return row_components(docs, words, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def one_of_each_class(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their class, with all their columns. Only rows that may go are shuffled."""
    row, maybe = fresh(docs, "row", "maybe")
    numbered = written_once(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = _components(numbered.select(F.col(row).alias("row"), "doc_id", "text"), words, percent)
    goes = cut_lineage(found.filter("class_row <> row").select(F.col("row").alias(row)))
    flagged = marked(numbered, row, goes, maybe)
    kept = flagged.filter(F.col(maybe)).join(goes, row, "left_anti")
    return flagged.filter(~F.col(maybe)).select(*docs.columns).unionByName(kept.select(*docs.columns))
