"""Embedding near-dedup with an inverted multi-index.

Each half of a unit vector has a codebook of its own; the pair of nearest codes is the vector's cell on the product
grid. A vector visits cells in the order of their distance, by multi-sequence traversal of the two sorted code
lists, as many as reach the target recall, and is compared with all vectors of its label there, exactly and in double precision.

Codebooks are fitted on at most ``sample`` vectors, one code for each 16 of them at most; every vector is indexed. A
grid of the default sample has up to 1,250 x 1,250 cells, for some 200 million vectors a label; give a larger sample for more. The number of cells to visit is set
on vectors moved to exactly the threshold away from sampled ones, the hardest links there can be, so it doesn't
depend on how many links a sample happens to hold.

Defined cases
    * null label, null or zero vector, or a null, NaN or infinite component: no links, its own component, kept;
    * vectors of different length never link; equal vectors of a label (repeated rows included) are compared once and all linked;
    * a cell however full is compared block by block; a null id counts as the largest;
    * empty table: empty result; only the three named columns are read, so other columns' names don't matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.llm.common import cut_lineage
from navloom.llm.components import connected_components

BLOCK = 2048


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # no overflow in the squares
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1)[None], 0)


def fit_codes(x: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """k-means from distinct random rows; an empty code keeps its place."""
    random = np.random.default_rng(seed)
    codes = x[random.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        nearest = _distances(x, codes).argmin(1)
        counts = np.bincount(nearest, minlength=len(codes))
        sums = np.stack([np.bincount(nearest, weights=x[:, j], minlength=len(codes)) for j in range(x.shape[1])], 1)
        codes = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], codes)
    return codes


def multi_sequence(d1: np.ndarray, d2: np.ndarray, visits: int) -> list[int]:
    """Cells (i * len(d2) + j) in ascending order of d1[i] + d2[j]: a heap walks the grid of the two sorted lists."""
    o1, o2 = d1.argsort(kind="stable"), d2.argsort(kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap, out, width = [(s1[0] + s2[0], 0, 0)], [], len(d2)
    while heap and len(out) < visits:
        _, i, j = heapq.heappop(heap)
        out.append(int(o1[i]) * width + int(o2[j]))
        if j + 1 < len(s2):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return out


@dataclass(frozen=True)
class MultiIndex:
    first: np.ndarray
    second: np.ndarray
    visits: int

    @classmethod
    def fit(cls, sample: np.ndarray, k: int, cosine: float, recall: float, seed: int = 7, probes: int = 1500) -> MultiIndex:
        x = unit(sample)
        half = x.shape[1] // 2
        index = cls(fit_codes(x[:, :half], k, seed), fit_codes(x[:, half:], k, seed + 1), 0)
        random = np.random.default_rng(seed + 2)
        some = x[random.permutation(len(x))[:probes]]
        away = random.standard_normal(some.shape)
        away -= (away * some).sum(1)[:, None] * some
        length = np.sqrt((away * away).sum(1))[:, None]
        other = cosine * some + np.sqrt(1 - cosine**2) * np.divide(away, length, out=np.zeros_like(away), where=length > 0)
        # A link is found from either end, so the better rank of the two counts.
        ranks = np.minimum(index.ranks(some, index.cells(other)), index.ranks(other, index.cells(some)))
        return cls(index.first, index.second, int(np.quantile(ranks, recall, method="higher")) + 1)

    def ranks(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells a traversal visits before it comes to the given one, for each vector; no cell is walked for it."""
        out = np.zeros(len(x), np.int64)
        for i, (a, b) in enumerate(zip(*self._both(x), strict=True)):
            bound = a[cells[i] // len(b)] + b[cells[i] % len(b)]
            # The cell itself is not counted; cells as far as it are.
            out[i] = np.searchsorted(np.sort(b), bound + 1e-12 - a, "right").sum() - 1
        return out

    def _both(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = x.shape[1] // 2
        return _distances(x[:, :half], self.first), _distances(x[:, half:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self._both(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def order(self, x: np.ndarray, visits: int) -> Iterator[list[int]]:
        for a, b in zip(*self._both(x), strict=True):
            yield multi_sequence(a, b, visits)


def _grid_size(vectors: int, labels: int, sample: int) -> int:
    """Codes per half, so that a cell of a label holds some 128 vectors; a code is fitted on 16 of the sample at least."""
    return int(min(max(4, sample // 16), max(4, np.ceil(np.sqrt(vectors / (128 * max(1, labels)))))))


def _indexed(distinct: DataFrame, indexes: dict[int, MultiIndex]) -> DataFrame:
    """Adds each vector's own cell and the cells it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding").to_pylist()
            own, visited = [0] * len(vectors), [[0]] * len(vectors)
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_dim.setdefault(len(v), []).append(i)
            for dim, rows in by_dim.items():
                if dim in indexes:
                    x = unit(np.array([vectors[i] for i in rows]))
                    for i, c, o in zip(rows, indexes[dim].cells(x).tolist(), indexes[dim].order(x, indexes[dim].visits), strict=True):
                        own[i], visited[i] = c, o
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(visited, pa.list_(pa.int32()))], [*batch.schema.names, "cell", "visited"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema.fields)
    return distinct.mapInArrow(run, f"{fields}, cell int, visited array<int>")


def _compare(cosine: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Links between the visiting and the stored vectors of a cell: their number for each end, and what is connected."""
        stored, visiting = group[group["stored"]], group[~group["stored"]]
        if not len(stored) or not len(visiting):
            return pd.DataFrame({"row": [], "links": [], "root": []}, dtype="int64")
        s, q = unit(np.stack(stored["embedding"])), unit(np.stack(visiting["embedding"]))
        srow, qrow = stored["row"].to_numpy(), visiting["row"].to_numpy()
        sweight, qweight = stored["copies"].to_numpy(), visiting["copies"].to_numpy()
        qcell, back = visiting["own"].to_numpy(), np.stack(stored["visited"])
        rows = np.unique(np.concatenate([srow, qrow]))
        sat, qat = np.searchsorted(rows, srow), np.searchsorted(rows, qrow)
        links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for at in range(0, len(q), 128):
            hit = q[at : at + 128] @ s.T >= cosine
            hit &= qrow[at : at + 128, None] != srow[None]
            for i in np.flatnonzero(hit.any(1)):
                ys = np.flatnonzero(hit[i])
                joined = np.unique(root[np.append(sat[ys], qat[at + i])])
                if len(joined) > 1:
                    root[np.isin(root, joined)] = joined[0]
                # Where the other end visits back, the smaller row counts the link for both.
                ys = ys[(qrow[at + i] < srow[ys]) | ~(back[ys] == qcell[at + i]).any(1)]
                links[qat[at + i]] += sweight[ys].sum()
                links[sat[ys]] += qweight[at + i]
        some = (links > 0) | (root != np.arange(len(rows)))
        return pd.DataFrame({"row": rows[some], "links": links[some], "root": rows[root[some]]})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, recall: float = 0.999, sample: int = 20_000) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id, embedding, label)."""
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = cut_lineage(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "embedding", F.coalesce(F.when(sound, length > 0), F.lit(False)).alias("sound")))
    distinct = rows.filter("sound").groupBy("label", "embedding").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"))
    distinct = cut_lineage(distinct.withColumn("dim", F.size("embedding")))
    dims = [r["dim"] for r in distinct.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(64).collect()]
    indexes = {}
    for dim in dims:
        own = distinct.filter(F.col("dim") == dim)
        total = own.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("label").alias("labels")).first()
        taken = own.select("embedding", F.xxhash64("row").alias("h"), "row").orderBy("h", "row").limit(sample).toPandas()
        if dim > 1:
            indexes[dim] = MultiIndex.fit(np.stack(taken["embedding"]), _grid_size(total["n"], total["labels"], sample), cosine, recall)
    found = cut_lineage(_indexed(distinct, indexes))
    key = ["label", "dim", "cell"]
    base = found.select("row", "label", "dim", "copies", "embedding", "visited", F.col("cell").alias("own"))
    stored = base.select("*", F.col("own").alias("cell"), F.lit(True).alias("stored"))
    visiting = base.select("*", F.explode("visited").alias("cell"), F.lit(False).alias("stored")).withColumn("visited", F.array().cast("array<int>"))
    blocks = [F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(n) for n in ("sblocks", "qblocks")]
    full = stored.groupBy(*key).agg(blocks[0]).join(found.select("label", "dim", F.explode("visited").alias("cell")).groupBy(*key).agg(blocks[1]), key)
    placed = stored.unionByName(visiting).join(full, key)
    block, others = (F.when(F.col("stored"), F.col(a)).otherwise(F.col(b)) for a, b in (("sblocks", "qblocks"), ("qblocks", "sblocks")))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("row"), block).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    left = F.when(F.col("stored"), F.col("block")).otherwise(F.col("other")).alias("left")
    right = F.when(F.col("stored"), F.col("other")).otherwise(F.col("block")).alias("right")
    compared = cut_lineage(placed.select(*key, left, right, "row", "copies", "embedding", "visited", "own", "stored").groupBy(*key, "left", "right").applyInPandas(_compare(cosine), "row long, links long, root long"))
    links = compared.groupBy("row").agg(F.sum("links").alias("links"))
    components = connected_components(compared.select(F.col("row").alias("a"), F.col("root").alias("b")))
    heads = distinct.select("label", "embedding", F.col("row").alias("head"), "copies")
    members = rows.filter("sound").join(heads, ["label", "embedding"]).select("vec_id", "head", "copies")
    members = members.join(links.withColumnRenamed("row", "head"), "head", "left").join(components.select(F.col("node").alias("head"), "component"), "head", "left")
    members = cut_lineage(members.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "head").alias("component")))
    least = members.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    some = members.join(least, "component").select("vec_id", "n_links", "component_id")
    none = rows.filter("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
