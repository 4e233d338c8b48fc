"""Boosted trees for logistic loss, fitted in numpy on a bounded sample and compiled to Spark columns."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """A split ``feature <= threshold`` with its two sides, or a leaf (feature -1) with its value."""

    value: float
    feature: int = -1
    threshold: float = 0.0
    low: Tree | None = None
    high: Tree | None = None


#: One condition of a rule: feature, whether "at most" (else "above"), threshold.
Condition = tuple[int, bool, float]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    out = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        middles = (values[:-1] + values[1:]) / 2
        out.append(middles if len(middles) < bins else np.unique(np.quantile(middles, np.linspace(0, 1, bins - 1))))
    return out


def _grow(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, least: int, ridge: float, bins: int) -> Tree:
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, -1, 0)
    if depth and len(rows) >= 2 * least:
        for j, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[rows, j]
            gl, hl, nl = (np.cumsum(np.bincount(b, weights=w, minlength=bins))[: len(e)] for w in (grad[rows], hess[rows], np.ones(len(rows))))
            gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
            gain[(nl < least) | (len(rows) - nl < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, k)
    if best[1] < 0:
        return Tree(float(-g / (h + ridge)))
    _, j, k = best
    low = binned[rows, j] <= k
    sides = [_grow(binned, edges, grad, hess, rows[s], depth - 1, least, ridge, bins) for s in (low, ~low)]
    return Tree(float(-g / (h + ridge)), j, float(edges[j][k]), *sides)


def predict(tree: Tree, x: np.ndarray) -> np.ndarray:
    if tree.low is None or tree.high is None:
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] <= tree.threshold, predict(tree.low, x), predict(tree.high, x))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, least: int = 5, ridge: float = 1.0, bins: int = 64) -> tuple[float, list[Tree]]:
    """A first score and trees whose values add up to the log-odds; deterministic."""
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    edges = _edges(x, bins)
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    score, out = np.full(len(y), base), []
    for _ in range(trees):
        p = sigmoid(score)
        tree = _grow(binned, edges, p - y, p * (1 - p), np.arange(len(y)), depth, least, ridge, bins)
        tree = _scaled(tree, rate)
        out.append(tree)
        score = score + predict(tree, x)
    return base, out


def _scaled(tree: Tree, rate: float) -> Tree:
    if tree.low is None or tree.high is None:
        return Tree(tree.value * rate)
    return Tree(tree.value * rate, tree.feature, tree.threshold, _scaled(tree.low, rate), _scaled(tree.high, rate))


def paths(tree: Tree, so_far: tuple[Condition, ...] = ()) -> Iterator[tuple[Condition, ...]]:
    """The conditions on the way to each node below the root."""
    if so_far:
        yield so_far
    if tree.low is not None and tree.high is not None:
        yield from paths(tree.low, (*so_far, (tree.feature, True, tree.threshold)))
        yield from paths(tree.high, (*so_far, (tree.feature, False, tree.threshold)))


def tree_column(tree: Tree, features: Sequence[Column] | Mapping[int, Column]) -> Column:
    if tree.low is None or tree.high is None:
        return F.lit(tree.value)
    return F.when(features[tree.feature] <= F.lit(tree.threshold), tree_column(tree.low, features)).otherwise(tree_column(tree.high, features))
