"""A quality classifier as a sparse rule ensemble.

Each text becomes a few statistics. Boosted trees are fitted on a bounded sample of labelled rows, the paths to
their nodes become conjunctive rules, a lasso-penalised logistic regression gives most rules the weight 0, and
those left are compiled into one Spark column over the statistics.

Labels, language, source and id are never inputs of a score. Rows whose crc32(id as text) mod 5 is 0 are held out.

Defined cases
    * null and empty texts have statistics 0 and a score like any other; very long texts are read whole;
    * null labels and labels other than 0 and 1 are not learned from; without any label, or with one class only, the score is the share of label 1 (0.5 without labels);
    * repeated rows and ids are scored row by row; a null id is never learned from and is not held out;
    * empty table: empty result; only the id and text columns are read, so other columns' names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navloom.llm.common import cut_lineage, fresh, small_batches
from navloom.llm.shingles import parts, rolled, words_of
from navloom.llm.trees import Condition, boost, paths, sigmoid

#: At most so many labelled rows are learned from.
LEARN_ROWS = 20_000

_CLASSES = ("upper", "lower", "digit", "blank", "line_end", "stop", "bang", "bar", "sign", "beyond")
STATISTICS = (
    "chars", "words", "word_size", "short_words", "different_words", "commonest_word", "same_as_before", "repeated_runs",
    "upper", "digit", "line_end", "stop", "bang", "bar", "sign", "beyond", "size_spread", "line_words",
)


def _byte_classes() -> np.ndarray:
    out = np.full(256, _CLASSES.index("beyond"))
    for b in range(128):
        c = chr(b)
        name = "upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit() else "line_end" if c == "\n" else "blank" if c.isspace() else {".": "stop", ",": "stop", "!": "bang", "|": "bar"}.get(c, "sign")
        out[b] = _CLASSES.index(name)
    return out


_CLASS_OF = _byte_classes()


def _some_statistics(texts: pa.Array) -> np.ndarray:
    hashes, sizes, edges, letters, bounds = words_of(texts)
    n = len(texts)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    counts = np.bincount(owner * len(_CLASSES) + _CLASS_OF[letters], minlength=n * len(_CLASSES)).reshape(n, -1).astype(float)
    share = counts / np.maximum(1, counts.sum(1, keepdims=True))
    runs = rolled(hashes, 3)
    out = np.zeros((n, len(STATISTICS)))
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        words = b - a
        if not words:
            out[i, 0] = bounds[i + 1] - bounds[i]
            continue
        _, often = np.unique(hashes[a:b], return_counts=True)
        own = runs[a : max(a, b - 2)]
        out[i, :8] = (
            bounds[i + 1] - bounds[i], words, sizes[a:b].mean(), (sizes[a:b] <= 3).mean(), len(often) / words, often.max() / words,
            (hashes[a + 1 : b] == hashes[a : b - 1]).mean() if words > 1 else 0, 1 - len(np.unique(own)) / len(own) if len(own) else 0,
        )
        out[i, 16:] = sizes[a:b].std(), words / (1 + counts[i, _CLASSES.index("line_end")])
    for j, name in enumerate(STATISTICS):
        if name in _CLASSES:
            out[:, j] = share[:, _CLASSES.index(name)]
    return np.round(out, 9)


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``STATISTICS`` of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in parts(batch.column(1)):
                stats = _some_statistics(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *(pa.array(stats[:, j]) for j in range(len(STATISTICS)))], ["doc_id", *STATISTICS])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{s} double" for s in STATISTICS))


def held_out(id_col: str | Column) -> Column:
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class RuleModel:
    """Log-odds = intercept + the weights of the rules that hold."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self, features: Sequence[Column]) -> Column:
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for feature, at_most, threshold in conditions:
                holds &= features[feature] <= threshold if at_most else features[feature] > threshold
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _hold(rules: Sequence[tuple[Condition, ...]], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, conditions in enumerate(rules):
        for feature, at_most, threshold in conditions:
            out[:, k] *= (x[:, feature] <= threshold) if at_most else (x[:, feature] > threshold)
    return out


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 250) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the intercept is not penalised."""
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    full = np.column_stack([np.ones(len(x)), x])
    step = 4 * len(x) / np.linalg.norm(full, 2) ** 2
    w = np.zeros(full.shape[1])
    w[0] = np.log(share / (1 - share))
    z, t = w.copy(), 1.0
    for _ in range(rounds):
        new = z - step * (full.T @ (sigmoid(full @ z) - y)) / len(x)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 3, penalty: float = 4e-4) -> RuleModel:
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return RuleModel(float(np.log(share / (1 - share))), ())
    _, forest = boost(x, y, trees=trees, depth=depth, rate=0.3, least=max(2, len(y) // 400))
    rules = list(dict.fromkeys(r for tree in forest for r in paths(tree)))
    hold = _hold(rules, x)
    # Of rules that hold for the same rows, the first (shortest) will do.
    _, first = np.unique(np.packbits(hold.astype(bool), axis=0), axis=1, return_index=True)
    rules, hold = [rules[k] for k in sorted(first)], hold[:, sorted(first)]
    intercept, weights = lasso_logistic(hold, y, penalty)
    return RuleModel(intercept, tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6))


def learn(statistics: DataFrame, labels: DataFrame, max_rows: int = LEARN_ROWS) -> RuleModel:
    """Fit on at most ``max_rows`` labelled rows, those with the smallest hashes, none of them held out."""
    known = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = statistics.join(known, "doc_id").filter(~held_out("doc_id")).orderBy(F.xxhash64("doc_id"), *STATISTICS).limit(max_rows).select("quality", *STATISTICS).toPandas()
    return fit_rules(rows[list(STATISTICS)].to_numpy(float), rows["quality"].to_numpy(float))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = LEARN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 at ``threshold`` or above) of every row."""
    statistics = cut_lineage(text_statistics(docs))
    score = learn(statistics, labels, max_rows).score([F.col(s) for s in STATISTICS])
    return statistics.select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = LEARN_ROWS) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, with all their columns. No row's text is moved."""
    stats = fresh(docs, *STATISTICS)
    model = learn(cut_lineage(text_statistics(docs)), labels, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in parts(batch.column("text")):
                found = _some_statistics(part)
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(part)).columns, *(pa.array(found[:, j]) for j in range(len(STATISTICS)))], [*batch.schema.names, *stats])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    scored = docs.mapInArrow(run, f"{fields}, " + ", ".join(f"{s} double" for s in stats))
    return scored.filter(model.score([F.col(s) for s in stats]) >= threshold).select(*docs.columns)
