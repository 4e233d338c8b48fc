from __future__ import annotations

import random
from datetime import date
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F

from navloom.functions.text import index_key, strip_tri
from navloom.operators import reference
from navloom.sources import sheets


def plain_chain(merged, start):
    path = [start]
    while merged.get(path[-1]) is not None and merged[path[-1]] not in path:
        path.append(merged[path[-1]])
    return [(start, i, a, b) for i, (a, b) in enumerate(zip(path, path[1:]), start=1)]


def test_merger_chains_of_any_length(spark):
    r = random.Random(6)
    names = r.sample(range(10_000), 300)
    merged = dict(zip(names[:120], names[1:121]))  # one chain of 120 steps
    merged |= dict(zip(names[130:140], [*names[131:140], names[130]]))  # a circle
    merged |= {names[141]: names[135], names[142]: names[141], names[150]: names[150], names[151]: names[60]}
    rows = [(n, merged.get(n)) for n in names]
    got = sorted(tuple(x) for x in reference.merger_chains(spark.createDataFrame(rows, "scheme_id long, merged_into long")).select("scheme_id", "step", "predecessor", "successor").collect())
    assert got == sorted(x for n in names for x in plain_chain(merged, n))
    assert max(x[1] for x in got) == 120
    assert reference.merger_chains(spark.createDataFrame([(1, None)], "scheme_id long, merged_into long")).collect() == []


def test_rates_are_looked_up_by_day(spark):
    asks = spark.createDataFrame([(i, date(2024, 1, d)) for i, d in enumerate((1, 5, 5, 9, 31))], "id int, on date")
    rates = spark.createDataFrame([(date(2024, 1, 5), 6.0), (date(2024, 1, 10), 7.0)], "observed date, rate double")
    assert [(x.id, x.risk_free) for x in reference.risk_free_on(asks, rates, "on").orderBy("id").collect()] == [(0, None), (1, 6.0), (2, 6.0), (3, 6.0), (4, 7.0)]


def total_of(values, codes, quantities, share):
    """Which rows are totals, found by trying every run of rows below, the innermost first."""
    children, found = {len(values): []}, {}

    def after(i):
        return found[i] + 1 if i in found else i + 1

    for i in range(len(values) - 1, -1, -1):
        if values[i] is None or codes[i] or quantities[i] is not None or not values[i]:
            continue
        total, j = Decimal(0), i + 1
        while j < len(values) and values[j] is not None:
            total += values[j]
            end = after(j) - 1
            if abs(total - values[i]) <= abs(values[i]) * share:
                found[i] = end
                break
            j = after(j)
    del children
    return found


def test_totals_are_found_as_by_trying_every_run():
    r = random.Random(12)
    for _ in range(300):
        values, codes, quantities = [], [], []
        for _ in range(r.randint(1, 14)):
            depth = r.random()
            value = None if depth < 0.05 else Decimal(r.choice([-3, 0, 1, 2, 3, 5, 6, 8, 10]))
            values.append(value)
            codes.append("INF" if r.random() < 0.4 else "")
            quantities.append(Decimal(1) if r.random() < 0.2 else None)
        got = sheets._totalled(codes, quantities, [float("nan") if v is None else v for v in values])
        assert got == total_of(values, codes, quantities, sheets.SUBTOTAL_SHARE), (values, codes, quantities)


def test_nested_totals_name_their_sections(spark):
    schema = "file_id string, sheet string, row_number int, kind string, section string, name string, isin string, quantity decimal(24,6), value decimal(24,6)"
    rows = [("Equity", None, 30), ("Listed", None, 10), ("a", 1, 4), ("b", 1, 6), ("Unlisted", None, 20), ("c", 1, 20), ("Cash", None, 5)]
    table = [("f", "s", i, "security", None, n, "X" if q else "", Decimal(q) if q else None, Decimal(v)) for i, (n, q, v) in enumerate(rows)]
    got = [(x.name, x.kind, x.section) for x in sheets.without_subtotals(spark.createDataFrame(table, schema)).orderBy("row_number").collect()]
    assert [k for _, k, _ in got] == ["subtotal", "subtotal", "security", "security", "subtotal", "security", "security"]
    assert got[6][2] is None and got[2][2] == sheets.nest(sheets.nest(None, "Equity"), "Listed") and got[5][2] == sheets.nest(sheets.nest(None, "Equity"), "Unlisted")
    assert pd.isna(table[0][4])


def test_marks_of_total_return_go_until_none_is_left(spark):
    said = spark.createDataFrame([("Nifty 50 TRItri x",), ("Nifty 50 (TRI)",), ("NIFTY 50 - TRI TRI",), ("Nifty 50 Total Return Index",)], "t string")
    assert [x[0] for x in said.select(index_key(F.col("t"))).collect()] == ["NIFTY50X", "NIFTY50", "NIFTY50", "NIFTY50"]
    assert not [x[0] for x in said.select(strip_tri(F.col("t"))).collect() if " tri" in x[0] or "(tri)" in x[0]]
