"""Work at size: pairs of funds don't move, lists of funds and positions do."""

from __future__ import annotations

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from navloom.operators import lookthrough as L


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def least(a, b):
    known = [x for x in (a, b) if x is not None]
    return min(known) if known else None


def added(values):
    known = [v for v in values if v is not None]
    return sum(known) if known else None


def brute_pairs(rows, values):
    """Pair by pair, as the SQL says it: rows are (fund, issuer, class, synthetic, weight)."""
    real = [r for r in rows if r[3] is False and r[0] is not None]
    size = lambda s: sum((r[4] or 0.0) if r[2] == "equity" else 0.0 for r in real if r[0] == s) or 1.0
    out = {}
    for a in {r[0] for r in real}:
        for b in {r[0] for r in real if r[0] > a}:
            both = [(x, y) for x in real if x[0] == a for y in real if y[0] == b and x[1] is not None and x[1] == y[1]]
            if both:
                part = lambda w, by: None if w is None else w * by
                equity = [least(part(x[4], 1 / size(a)), part(y[4], 1 / size(b))) if x[2] == y[2] == "equity" else 0.0 for x, y in both]
                inr = [least(part(x[4], values.get(a, 0.0)), part(y[4], values.get(b, 0.0))) for x, y in both]
                n = sum(r[0] in (a, b) for r in real)
                out[a, b] = (added(least(x[4], y[4]) for x, y in both), added(None if q is None else q * 100 for q in equity), added(None if i is None else i / 100 for i in inr), len(both), n - len(both))
    return out


SCHEMA = "scheme_id long, issuer_id long, instrument_class string, is_synthetic boolean, weight double"


def made_weights():
    random.seed(7)
    kind = {i: random.choice(["equity", "debt", None]) for i in range(40)}
    rows = [(s, i, kind[i], i % 9 == 0, random.choice([None, 0.0, random.uniform(-1, 9)]) if i % 5 == 0 else random.uniform(0, 9)) for s in range(30) for i in range(40) if random.random() < 0.2]
    return rows + [(30, None, "equity", False, 5.0), (31, None, "equity", False, 5.0), (None, 1, "debt", False, 5.0), (32, 1, "debt", None, 5.0), (33, 10, "debt", False, None), (34, 10, "debt", False, None)]


def test_pairs_are_summed_where_they_meet(spark):
    rows, values = made_weights(), {s: 100.0 * s for s in range(0, 30, 2)}
    got = L.overlap_pairs(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(list(values.items()), "scheme_id long, value_inr double"))
    above = plan(got).split("MapInArrow")[0]
    assert "Exchange" not in above and "Aggregate" not in above
    want = brute_pairs(rows, values)
    found = {(r.scheme_a, r.scheme_b): r for r in got.collect()}
    assert set(found) == set(want) and got.count() == len(want) and found[33, 34].overlap_pct is None
    for k, w in want.items():
        r = found[k]
        assert [r.overlap_pct, r.equity_overlap_pct, r.overlap_inr, r.common, r.union_issuers] == [pytest.approx(x) if isinstance(x, float) else x for x in w], k
        assert r.jaccard == pytest.approx(r.common / r.union_issuers)


def test_funds_of_any_kind_of_key(spark):
    rows = [("a", "x", "equity", False, 60.0), ("b", "x", "equity", False, 30.0), ("b", "y", "debt", False, 70.0), ("c", "z", "debt", False, 1.0)]
    got = L.overlap_pairs(spark.createDataFrame(rows, "scheme_id string, issuer_id string, instrument_class string, is_synthetic boolean, weight double"))
    assert [tuple(r) for r in got.collect()] == [("a", "b", 30.0, pytest.approx(100.0), 0.0, 1, 2, 0.5)]
    assert L.overlap_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("own", [True, False])
def test_a_fund_that_meets_many_takes_several_steps(monkeypatch, own):
    """With any number of entries a step the same sums."""
    random.seed(3)
    held = [sorted(random.sample(range(60), random.choice([1, 5, 50]))) for _ in range(24)]
    side = [0 if own else s % 2 for s in range(24)]
    batch = pa.RecordBatch.from_pydict({
        "scheme_id": list(range(24)), "n": [len(h) for h in held], "sleeve": [1.0] * 24, "value_inr": [2.0] * 24, "issuer_id": held, "weight": [[float(i + s) for i in h] for s, h in enumerate(held)],
        "equity": [[i % 2 == 0 for i in h] for h in held], "side": side, "other": [0 if own else 1 - x for x in side]})
    want = {(a, b): sum(i + a for i in held[a] if i in held[b]) for a in range(24) for b in range(a + 1, 24) if (own or side[a] != side[b]) and set(held[a]) & set(held[b])}
    for most in (1, 7, 100, 1 << 21):
        monkeypatch.setattr(L, "MET", most)
        out = [r for b in L._overlaps(iter([batch.slice(0, 10), batch.slice(10)])) for r in b.to_pylist()]
        assert len(out) == len(want) and {(min(r["fund"], r["other_fund"]), max(r["fund"], r["other_fund"])): r["overlap_pct"] for r in out} == want


SF = "/root/testdata/sf0.001"


def test_the_newest_run_meets_no_scopes(spark, tmp_path):
    from navloom.operators.store import Store

    rows = spark.createDataFrame([(u, x) for u in range(6) for x in "ab"], "u long, x string")
    store = Store(spark, str(tmp_path / "s"), ["u"], rows.schema)
    assert store.current().count() == 0
    store.save(rows.withColumn("x", F.lit("old")), rows.select("u"))
    assert "Join" not in plan(store.current())
    store.save(rows.filter("u % 2 = 0"), rows.filter("u % 2 = 0 or u = 5").select("u"))
    assert plan(store.current()).count("Join") == 1
    assert sorted(map(tuple, store.current().collect())) == sorted([(u, x) for u in (0, 2, 4) for x in "ab"] + [(u, "old") for u in (1, 3) for _ in "ab"])


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables")
def test_stored_pairs_are_written_once(spark):
    import __spark_entry__ as entry
    from navloom.sources.store import shared_folder

    top = os.path.dirname(shared_folder(spark, "any")).removeprefix("file:")
    before = set(os.listdir(top))
    stored = entry.queries()["stored_overlaps"](spark, SF)
    made = sorted(set(os.listdir(top)) - before)
    assert [name.split("-")[0] for name in made] == ["lists", "store"]
    want = entry.queries()["overlap_pairs"](spark, SF)
    assert spark.read.parquet(f"{top}/{made[1]}/rows").count() == want.count() > 0
    assert stored.exceptAll(want).count() == want.exceptAll(stored).count() == 0


def test_opened_units_lie_by_issuer(spark):
    """An issuer's rows lie in one task, each fund's in their order; lists of several funds, nulls and what is lost come out as before."""
    from navloom.operators import weights

    held = [(f, i, float(1 + (f * i) % 13)) for f in range(1, 41) for i in range(1, 60) if (f + i) % 3] + [(50, 1, 100.0), (51, None, 40.0), (51, 8, 60.0), (52, 2, None), (52, 3, 5.0)]
    units = [(8, 60), (15, 51), (22, 52), (29, 3), (36, 50)]
    got = weights.expand_fund_units(spark.createDataFrame(held, "scheme_id long, issuer_id long, weight double"), spark.createDataFrame(units, "issuer_id long, held_scheme long"))
    rows = got.select("*", F.spark_partition_id().alias("task")).collect()
    tasks = {}
    for r in rows:
        tasks.setdefault(r.issuer_id, set()).add(r.task)
    assert all(len(t) == 1 for t in tasks.values()) and len({next(iter(t)) for t in tasks.values()}) > 10
    found = {(r.scheme_id, r.issuer_id): (r.weight, r.depth) for r in rows}
    assert len(found) == len(rows)
    assert found[51, "__MFUNIT__"] == (100.0, 0) and found[52, "2"] == (None, 0) and found[52, "3"] == (5.0, 0)
    # Fund 40 holds 51 by issuer 15 (weight 3), so what 51 lists without an id, and its lost units of 60, come to the bucket.
    assert found[40, "2"][1] in (0, 1) and found[40, "__MFUNIT__"][1] >= 1
    for task in range(32):
        for f in {r.scheme_id for r in rows}:
            own = [int(r.issuer_id) for r in rows if r.task == task and r.scheme_id == f and r.issuer_id.isdigit()]
            assert own == sorted(own)


def test_rounding_of_many_rows_is_that_of_few(spark):
    from navloom.plans.base import rounded, rounded_many

    random.seed(1)
    values = [random.choice([random.uniform(-1e-5, 1e-5), random.uniform(-3, 3), random.randrange(-(10**7), 10**7) / 2e6 + 5e-7, 10 ** random.uniform(-12, 18)]) for _ in range(5000)]
    df = spark.createDataFrame([(x,) for x in [*values, None, float("nan"), float("inf"), 5e-7, -5e-7, 2.675, -0.0]], "x double")
    for n in (2, 6, 9):
        assert [repr(r.x) for r in rounded(df, x=n).collect()] == [repr(r.x) for r in rounded_many(df, x=n).collect()]


def test_a_grid_is_made_where_its_funds_meet(spark):
    rows = made_weights()
    got = L.overlap_grid(spark.createDataFrame(rows, SCHEMA))
    above = plan(got).split("MapInArrow")[0]
    assert "Exchange" not in above and "Window" not in above
    order = sorted({r[0] for r in rows if r[0] is not None}) + [None]
    overlaps = {k: w[0] or 0.0 for k, w in brute_pairs(rows, {}).items()}
    cells = {(r.grid_row, r.grid_column): r.overlap_pct for r in got.collect()}
    assert got.count() == len(cells) == len(order) * (len(order) - 1) // 2
    for (row, column), value in cells.items():
        assert column < row and value == pytest.approx(overlaps.get((order[column - 1], order[row - 1]), 0.0)), (row, column)
    alone = L.overlap_grid(spark.createDataFrame([(1, 1, "equity", True, 5.0), (2, None, "equity", False, 5.0)], SCHEMA))
    assert [tuple(r) for r in alone.collect()] == [(2, 1, 0.0)]


def test_the_largest_overlap_moves_one_row_of_a_fund(spark):
    """Pairs are folded in the task that makes them."""
    import __spark_entry__ as entry

    above = plan(entry.queries()["max_pairwise_overlap"](spark, SF)).split("MapInArrow")[0]
    assert above.count("Exchange") == 1 and above.index("HashAggregate") < above.index("Exchange") < above.rindex("HashAggregate")


def test_a_view_opens_contributions_once(spark):
    """Covered funds are found from positions and weights, exposures are counted with the quality."""
    import __spark_entry__ as entry
    from navloom.operators import results as R

    assert plan(entry.queries()["view_envelopes"](spark, SF)).count("rangepartitioning(issuer_id") == 1
    positions = spark.createDataFrame([(1, 1, 10.0), (1, 1, 5.0), (1, 2, 20.0), (2, 3, 7.0), (2, None, 1.0), (3, 4, 2.0)], "user_id long, scheme_id long, value_inr double")
    weights = spark.createDataFrame([(1, 7, "equity", False, 60.0), (1, 8, "debt", True, 40.0), (2, 7, "debt", False, 100.0), (4, None, "debt", False, 100.0)], SCHEMA)
    dates = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-05")], "scheme_id long, day string").select("scheme_id", F.col("day").cast("date").alias("holdings_as_of"))
    contributed, on = L.contributions(positions, weights), F.lit("2024-01-11").cast("date")
    held = R.covered_funds(positions, weights)
    short, whole = R.portfolio_quality(contributed, dates, on, held, counted=True), R.portfolio_quality(contributed, dates, on)
    assert plan(short).count("rangepartitioning(issuer_id") == 1
    assert sorted(map(str, short.drop("row_count").collect())) == sorted(map(str, whole.collect()))
    rows = {r.user_id: r["count"] for r in L.exposures(contributed).groupBy("user_id").count().collect()}
    assert {r.user_id: r.row_count for r in short.collect()} == rows == {1: 3, 2: 1, 3: 1}


def test_positions_move_as_two_arrays_to_few_ranges(spark):
    positions = spark.createDataFrame([(u, s, 10.0 * u + s) for u in range(70) for s in (1, 2)], "user_id long, scheme_id long, value_inr double")
    weights = spark.createDataFrame([(s, i, "equity", False, 10.0) for s in (1, 2) for i in range(10)], SCHEMA)
    moved = L._ranged(positions, weights)
    assert [f.dataType.simpleString() for f in moved.schema if f.name in ("users", "values")] == ["array<bigint>", "array<double>"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        below = plan(L.marginal(positions, weights)).split("rangepartitioning(issuer_id")[1]
        assert f", {L.RANGES})" in below.split("\n")[0] and L.RANGES < 300
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = L.marginal(positions, weights)
    assert got.count() == 140 and got.agg(F.sum("new_issuers")).first()[0] == 0


def test_stored_rows_take_little_room(spark, tmp_path):
    import pyarrow.parquet as pq

    from navloom.operators.store import Store

    rows = spark.range(1000).selectExpr("id % 2 AS u", "rand(1) AS x")
    Store(spark, str(tmp_path / "s"), ["u"], rows.schema).save(rows, rows.select("u"))
    files = list((tmp_path / "s" / "rows" / "run=1").glob("*.parquet"))
    assert files and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}
