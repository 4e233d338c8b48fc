"""Work at size: opened rows are few in a task, stored rows do not move to be checked, what is to be refreshed is found once."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navloom.operators import lookthrough as L
from navloom.operators import results as R
from navloom.operators.store import Store

HELD = "scheme_id long, issuer_id long, instrument_class string, is_synthetic boolean, weight double"
POSITIONS = "user_id long, scheme_id long, value_inr double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def held(spark):
    rows = [(s, i, "equity" if i % 3 else "debt", i % 7 == 0, float(1 + (s * i) % 11)) for s in range(1, 7) for i in range(1, 41) if (s + i) % 3]
    return spark.createDataFrame(rows, HELD).repartition(3)


@pytest.fixture(scope="module")
def positions(spark):
    return spark.createDataFrame([(u, s, 100.0 * u + s) for u in range(1, 71) for s in range(1, 8) if (u * s) % 4 != 1], POSITIONS)


def test_ranges_are_counted_and_not_joined_again(positions, held):
    assert "REPARTITION_BY_NUM" in plan(L.contributions(positions, held)) and L.contributions(positions, held).rdd.getNumPartitions() == 4


def test_marginal_opens_positions_by_whole_issuers(spark, positions, held):
    got = L.marginal(positions, held)
    assert "MapInArrow" in plan(got) and "Generate explode(held" not in plan(got)
    own = defaultdict(dict)
    for r in L.contributions(positions, held).filter("not is_synthetic").collect():
        own[r.user_id, r.issuer_id, r.instrument_class][r.scheme_id] = r.contribution_inr
    whole = defaultdict(lambda: defaultdict(float))
    for (u, i, c), funds in own.items():
        if c == "equity":
            whole[u][i] = sum(funds.values())
    hhi = lambda xs: sum(x * x for x in xs) / sum(xs) ** 2
    rows = got.collect()
    assert len(rows) == positions.filter("scheme_id < 7").count()
    for r in rows:
        mine = [(k, f) for k, f in own.items() if k[0] == r.user_id and r.scheme_id in f]
        assert r.new_issuers == sum(len(f) == 1 for _, f in mine) and r.new_exposure_inr == pytest.approx(sum(f[r.scheme_id] for _, f in mine if len(f) == 1))
        left = [x - own[r.user_id, i, "equity"].get(r.scheme_id, 0.0) for i, x in whole[r.user_id].items()]
        if sum(left) > 0.005:
            assert r.hhi_delta == pytest.approx(hhi(list(whole[r.user_id].values())) - hhi(left), abs=1e-12)


def test_an_issuer_that_goes_on_in_further_batches(spark, positions, held):
    key = lambda df: sorted((r.user_id, r.scheme_id, r.new_issuers, round(r.new_exposure_inr, 6), r.hhi_delta and round(r.hhi_delta, 9)) for r in df.collect())
    whole = key(L.marginal(positions, held))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert key(L.marginal(positions, held)) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_links_spread_only_weights_of_named_issuers(positions, held):
    top = L.top_with_others(L.exposures(L.contributions(positions, held)), 4).filter("rank <= 4").select("user_id", "issuer_id")
    links = L.top_links(positions, held, top)
    assert "rangepartitioning" not in plan(L.top_links(positions, held, positions.select("user_id", F.lit("3").alias("issuer_id"))))
    named = {(r.user_id, r.issuer_id) for r in top.collect()}
    wanted = defaultdict(float)
    for r in L.contributions(positions, held).collect():
        wanted[r.user_id, r.scheme_id, r.issuer_id if (r.user_id, r.issuer_id) in named else "others"] += r.contribution_inr
    assert {(r.user_id, r.scheme_id, r.link_to): pytest.approx(r.inr) for r in links.collect()} == wanted and any(k[2] == L.NO_DISCLOSURE for k in wanted)


def test_shares_in_a_fund_come_from_its_weights(positions, held):
    rows = R.contribution_rows(R.held_weights(positions, held))
    assert "Window" not in plan(rows).split("Generate explode(held")[0]
    whole = defaultdict(float)
    plain = {(r.user_id, r.scheme_id, r.issuer_id): r.contribution_inr for r in L.contributions(positions, held).collect()}
    for (u, s, _), x in plain.items():
        whole[u, s] += x
    got = {(r.user_id, r.scheme_id, r.issuer_id): (r.contribution_inr, r.weight_in_fund) for r in rows.collect()}
    assert got == {k: (pytest.approx(x), pytest.approx(x / whole[k[:2]] * 100)) for k, x in plain.items()}


def test_saved_rows_are_computed_once_and_do_not_move(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ["user_id"], T.StructType.fromDDL("user_id long, x long"))
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    inputs = spark.range(40).select(F.col("id").alias("user_id"), F.col("id").cast("string").alias("inputs")).mapInPandas(seen, "user_id long, inputs string")
    done = store.refresh(inputs, lambda scopes: scopes.select("user_id", F.lit(1).cast("long").alias("x")))
    assert (done.changed, store.current().count(), read.value) == (40, 40, 40)


def test_a_page_is_parsed_once(spark):
    from navloom.sources import disclosure_pages as P

    html = '<script id="__NEXT_DATA__">{"props":{"pageProps":{"mfServerSideData":{"scheme_name":"F","holdings":[{"company_name":"A","portfolio_date":"2026-06-29"},{"company_name":"B","portfolio_date":"2026-06-29"}]}}}}</script>'
    rows = P.page_holdings(spark.createDataFrame([("a", html)], "file_id string, html string"))
    optimised = rows._jdf.queryExecution().optimizedPlan().toString()
    assert optimised.count("from_json") + optimised.count("jsontostructs") <= 2 and "Join" not in optimised
    assert [(r.name, r.n_rows) for r in rows.orderBy("row_number").collect()] == [("A", 2), ("B", 2)]


def test_the_first_of_several_rates_and_none_beyond_the_steps(spark):
    from datetime import date, timedelta

    from navloom.operators.returns import money_weighted

    cases = {"two": [(0, -100.0), (365, 230.0), (730, -132.0)], "one": [(0, -100.0), (365, 110.0)], "steep": [(0, -10.0), (10, 20.0)], "none": [(0, 50.0), (400, -100.0), (900, 80.0)], "loss": [(0, -100.0), (365, 5.0)]}
    flows = spark.createDataFrame([(k, date(2024, 1, 1) + timedelta(d), f) for k, rows in cases.items() for d, f in rows], "book string, txn_date date, flow double")
    got = {r.book: r.xirr for r in money_weighted(flows, ["book"]).collect()}
    assert got == {"two": pytest.approx(0.1), "one": pytest.approx(0.1), "steep": None, "none": None, "loss": pytest.approx(-0.95)}
