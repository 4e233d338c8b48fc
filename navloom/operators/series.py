"""Series made smaller for display."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def largest_triangles(values: np.ndarray, keep: int) -> np.ndarray:
    """Indices to keep: of each bucket the point with the largest triangle to the last kept point and the next bucket's mean; lowest and highest always."""
    n = len(values)
    if n <= keep or keep < 3:
        return np.arange(n)
    x = np.arange(n, dtype=float)
    edges = np.linspace(1, n - 1, keep - 1).astype(int)
    out = [0]
    for b in range(keep - 2):
        a, e = edges[b], max(edges[b] + 1, edges[b + 1])
        follow = slice(e, edges[b + 2]) if b + 2 < len(edges) and edges[b + 2] > e else slice(n - 1, n)
        mx, my = x[follow].mean(), values[follow].mean()
        px, py = x[out[-1]], values[out[-1]]
        area = np.abs((px - mx) * (values[a:e] - py) - (px - x[a:e]) * (my - py))
        out.append(a + int(area.argmax()))
    return np.unique([*out, n - 1, int(values.argmin()), int(values.argmax())])


def thinned(series: DataFrame, key: str, date: str, value: str, keep: int = 500) -> DataFrame:
    """Each series with at most about ``keep`` points. A series is one fund's prices, some thousands of rows."""

    def thin(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(date, kind="stable").reset_index(drop=True)
        return ordered.iloc[largest_triangles(ordered[value].to_numpy(float), keep)]

    rows = series.select(key, date, value)
    return rows.groupBy(key).applyInPandas(thin, rows.schema)
