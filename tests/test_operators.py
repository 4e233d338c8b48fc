from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from navloom.functions import text as T
from navloom.operators import asof, fund, ledger, lookthrough, merge, nav, resolve, series, validate, weights
from navloom.sources import parsers
from navloom.streaming import activity


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalised_weights_are_exactly_100(spark):
    r = random.Random(1)
    rows = spark.createDataFrame([(s, i, float(r.randint(1, 10**9))) for s in range(5) for i in range(37)], "scheme_id int, issuer_id int, mv double")
    assert {str(x.total) for x in weights.sums_to_100(weights.normalised(rows)).collect()} == {"100.000000"}


def test_lookthrough_loses_no_rupee(spark):
    positions = spark.createDataFrame([(1, "a", 1, 60.0), (1, "b", 1, 40.0), (1, "a", 2, 50.0)], "user_id int, folio string, scheme_id int, value_inr double")
    held = spark.createDataFrame([(1, "X", "equity", False, 75.0), (1, "__CASH__", "cash", True, 25.0)], "scheme_id int, issuer_id string, instrument_class string, is_synthetic boolean, weight double")
    spread = lookthrough.checked_closure(positions, lookthrough.contributions(positions, held))
    got = {r.issuer_id: r.exposure_inr for r in lookthrough.exposures(spread).collect()}
    assert got == {"X": 75.0, "__CASH__": 25.0, lookthrough.NO_DISCLOSURE: 50.0}
    with pytest.raises(Exception, match="add up"):
        lookthrough.checked_closure(positions, lookthrough.contributions(positions.filter("scheme_id = 1"), held)).collect()
    with pytest.raises(ValueError, match="scope"):
        lookthrough.in_scope(lookthrough.exposures(spread), "gold")


def test_gini_of_equal_and_signed_pools(spark):
    rows = [(1, str(i), "equity", False, 10.0) for i in range(4)] + [(2, str(i), "equity", False, float(i - 1)) for i in range(4)]
    got = {r.user_id: r for r in lookthrough.concentration(spark.createDataFrame(rows, "user_id int, issuer_id string, instrument_class string, is_synthetic boolean, exposure_inr double"), "all").collect()}
    assert got[1].gini == pytest.approx(0) and got[1].effective_n == pytest.approx(4) and got[2].gini is None


def test_fund_units_stop_at_cycles_and_depth(spark):
    held = spark.createDataFrame([(1, "u2", 100.0), (2, "u1", 50.0), (2, "X", 50.0), (3, "u4", 100.0), (4, "u5", 100.0), (5, "u6", 100.0), (6, "Y", 100.0)], "scheme_id int, issuer_id string, weight double")
    units = spark.createDataFrame([(f"u{i}", i) for i in range(1, 7)], "issuer_id string, held_scheme int")
    got = {(r.scheme_id, r.issuer_id): r.weight for r in weights.expand_fund_units(held, units).collect()}
    assert got[1, "X"] == 50 and got[1, "__MFUNIT__"] == 50 and got[3, "__MFUNIT__"] == 100 and got[5, "Y"] == 100
    sums = {s: sum(w for (a, _), w in got.items() if a == s) for s in range(1, 7)}
    assert all(v == pytest.approx(100) for v in sums.values())


def test_asof_in_both_directions(spark):
    facts = spark.createDataFrame([("a", day(10), 1.0), ("a", day(20), 2.0)], "k string, d date, v double")
    asks = spark.createDataFrame([("a", day(n)) for n in (5, 10, 14, 15, 16, 25)] + [("b", day(12))], "k string, at date")
    back = {(r.k, r["at"]): r.v for r in asof.latest_on_or_before(asks, facts, ["k"], "at", "d", ["v"]).collect()}
    ahead = {(r.k, r["at"]): r.v for r in asof.first_on_or_after(asks, facts, ["k"], "at", "d", ["v"]).collect()}
    close = {(r.k, r["at"]): r.v for r in asof.nearest(asks, facts, ["k"], "at", "d", ["v"], 4).collect()}
    assert [back["a", day(n)] for n in (5, 10, 14, 25)] == [None, 1, 1, 2] and back["b", day(12)] is None
    assert [ahead["a", day(n)] for n in (5, 10, 14, 25)] == [1, 1, 2, None]
    assert [close["a", day(n)] for n in (5, 14, 15, 16, 25)] == [None, 1, None, 2, None]


def test_price_series(spark):
    prices = spark.createDataFrame([(1, day(n), v) for n, v in enumerate([1000.0, 1010.0, 101.0, 102.0, 51.0, 80.0, 102.0])], "scheme_id int, nav_date date, nav double")
    scaled = [r.nav_rescaled for r in nav.rescale_splits(prices).orderBy("nav_date").collect()]
    assert scaled == [100.0, 101.0, 101.0, 102.0, 51.0, 80.0, 102.0]
    worst = nav.max_drawdown(nav.rescale_splits(prices).select("scheme_id", "nav_date", F.col("nav_rescaled").alias("nav"))).first()
    assert (worst.depth, worst.peak_date, worst.trough_date, worst.recovery_date) == (-0.5, day(3), day(4), day(6))
    paid = spark.createDataFrame([(1, day(1), 505.0), (1, day(0), 5.0)], "scheme_id int, nav_date date, amount double")
    flat = spark.createDataFrame([(1, day(0), 1010.0), (1, day(1), 505.0)], "scheme_id int, nav_date date, nav double")
    assert [r.nav_adj for r in nav.adjust_payouts(flat, paid).orderBy("nav_date").collect()] == [1010.0, 1010.0]


def test_ranks_leave_gaps_and_small_groups_have_none(spark):
    rows = spark.createDataFrame([(i, "c", v) for i, v in enumerate([5.0, 4.0, 4.0, 1.0, 0.0])] + [(9, "d", 1.0)], "scheme_id int, category string, ret double")
    got = {r.scheme_id: (r.peer_rank, r.quartile) for r in fund.peer_ranks(rows, ["category"], "ret").collect()}
    assert got == {0: (1, 1), 1: (2, 2), 2: (2, 2), 3: (4, 4), 4: (5, 4), 9: (None, None)}


BOOK = "user_id int, folio string, scheme_id int, txn_ref int, txn_date date, txn_type string, units decimal(18,3), amount double, reverses_ref int"


def replay(rows):
    """First in, first out, one row after the other."""
    from decimal import Decimal

    lots, out = [], []
    for r in rows:
        if r[5] in ledger.OPENING:
            lots.append([r[3], Decimal(r[6]), r])
        elif r[5] in ledger.CLOSING:
            left = Decimal(r[6])
            while left > 0:
                used = min(left, lots[0][1])
                out.append((lots[0][0], r[3], float(used), (r[4] - lots[0][2][4]).days))
                lots[0][1] -= used
                left -= used
                if not lots[0][1]:
                    lots.pop(0)
    return out


def test_fifo_matches_a_replay(spark):
    from decimal import Decimal

    r, rows, held = random.Random(4), [], Decimal(0)
    for i in range(120):
        units = Decimal(r.randint(1, 9000)) / 1000
        sell = held > units and r.random() < 0.45
        held += -units if sell else units
        rows.append((1, "f", 1, i, day(i * 9), "REDEMPTION" if sell else r.choice(ledger.OPENING), units, float(units) * 10, None))
    txns = spark.createDataFrame(rows, BOOK)
    assert ledger.shortfalls(txns).count() == 0
    used = ledger.fifo(txns)
    got = sorted((x.lot_ref, x.close_ref, round(x.used, 3), x.holding_days) for x in used.collect())
    assert got == sorted((a, b, round(c, 3), d) for a, b, c, d in replay(rows))
    emptied = used.groupBy("lot_ref").agg(F.sum("used").alias("u"), F.sum("cost").alias("c")).collect()
    for x in emptied:
        whole = next(t for t in rows if t[3] == x.lot_ref)
        if abs(x.u - float(whole[6])) < 1e-9:
            assert x.c == pytest.approx(whole[7], abs=1e-9)
    short = spark.createDataFrame([(1, "f", 2, 1, day(0), "REDEMPTION", Decimal(1), 1.0, None)], BOOK)
    assert ledger.shortfalls(short).count() == 1


def test_rates_of_return():
    days = np.array([0, 365])
    assert ledger.solve_rate(days, np.array([-100.0, 110.0])) == pytest.approx(0.1, abs=1e-7)
    assert ledger.solve_rate(days, np.array([-100.0, 5.0])) == pytest.approx(-0.95, abs=1e-6)
    assert ledger.solve_rate(days, np.array([100.0, 5.0])) is None and ledger.solve_rate(days[:1], np.array([1.0])) is None


def test_names_codes_and_numbers(spark):
    assert one(spark, T.normalise_name(F.lit("The Société Générale & Co. Ltd"))) == "societe generale"
    assert one(spark, T.family_key(F.lit("HDFC Growth Mid Cap Fund - Direct Plan (Growth Option)"))) == "hdfc growth mid cap fund"
    assert one(spark, T.index_key(F.lit("NIFTY Midcap 150 Index TRI"))) == one(spark, T.index_key(F.lit("Nifty MIDCAP150"))) == "NIFTYMIDCAP150"
    assert [one(spark, T.is_composite(F.lit(x))) for x in ("A + B", "85 % Nifty 500", "Nifty SDL Plus AAA PSU", "Nifty 50")] == [True, True, False, False]
    assert [one(spark, T.is_valid_isin(F.lit(x))) for x in ("INE002A01018", "INE002A01019", " ine002a01018", "x", None)] == [True, False, True, False, False]
    assert [one(spark, T.group_indian(F.lit(x))) for x in ("1234567.891", "-999", "12345678901")] == ["12,34,567.89", "-999.00", "12,34,56,78,901.00"]
    assert [one(spark, T.indian_number(F.lit(x))) for x in ("(1,23,456.50)", "n/a")] == [-123456.5, None]
    assert [one(spark, T.defanged(F.lit(x))) for x in ("=1+1", "-5.2", "ok")] == ["'=1+1", "-5.2", "ok"]
    assert [one(spark, T.ordinal(F.lit(x))) for x in (1, 2, 3, 11, 112, 121)] == ["1st", "2nd", "3rd", "11th", "112th", "121st"]
    with pytest.raises(Exception, match="no unit"):
        one(spark, T.unit_of(F.lit("Market value in million")))


def test_set_ratio_and_longest_key(spark):
    assert resolve.set_ratio("tata steel", "steel tata") == 100 and resolve.set_ratio("abc", "xyz") == 0
    texts = spark.createDataFrame([(1, "fund on nifty next 50"), (2, "nifty 50 plus gold"), (3, "nothing")], "i int, t string")
    keys = spark.createDataFrame([("nifty",), ("nifty next 50",), ("next",)], "k string")
    assert {r.i: r.k for r in resolve.longest_contained(texts, keys, "t", "k").collect()} == {1: "nifty next 50", 2: None, 3: None}


def test_merges_and_checks(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, load int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, load int")
    assert {r.k: r.v for r in merge.last_wins(old, new, ["k"], "load").collect()} == {1: "a", 2: "c", 3: "d"}
    assert {r.k: r.v for r in merge.where_absent(old, new, ["k"]).collect()} == {1: "a", 2: "b", 3: "d"}
    assert [r.k for r in merge.changed_only(old, new, ["k"], "v").collect()] == [2]
    checks = spark.createDataFrame([(1, day(0), "V1", False, True), (2, day(0), "V3", False, False), (3, day(0), "V2", None, True)], "scheme_id int, as_of date, check string, passed boolean, blocking boolean")
    assert {r.scheme_id: r.status for r in validate.promote(checks).collect()} == {1: "quarantined", 2: "warn", 3: "ok"}


def test_price_text_and_statement(spark):
    head = "Scheme Code;ISIN Div Payout/ ISIN Growth;ISIN Div Reinvestment;Scheme Name;Net Asset Value;Date"
    lines = [head, "", "Open Ended(Equity)", "HDFC Mutual Fund", "101;INE002A01018;-;Fund A;12.5;31-Jul-2026", "Kotak Mutual Fund", "102;INE002A01019;INE002A01018;Fund B;N.A.;31-Jul-2026"]
    got = parsers.parse_nav(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")).orderBy("line_no").collect()
    assert [(r.house, r.category, r.code, r.nav and float(r.nav), r.isin, r.variant) for r in got] == [("HDFC Mutual Fund", "Open Ended(Equity)", "101", 12.5, "INE002A01018", "isin_payout"), ("Kotak Mutual Fund", "Open Ended(Equity)", "102", None, "INE002A01018", "isin_reinvest")]
    text = ["Folio No: 123 / 4", "Scheme: Fund A", "01-Apr-2026 Purchase 1,000.00 100.000 10.0000 100.000", "02-Apr-2026 IDCW Payout (50.00) 100.000", "Summary", "03-Apr-2026 Purchase 1.00 1.000 1.0 101.0"]
    rows = parsers.parse_statement(spark.createDataFrame([("s", i, x) for i, x in enumerate(text)], "file string, line_no int, line string")).orderBy("line_no").collect()
    assert [(r.folio, r.scheme, r.description, float(r.amount), r.units and float(r.units), float(r.balance)) for r in rows] == [("123/4", "Fund A", "Purchase", 1000.0, 100.0, 100.0), ("123/4", "Fund A", "IDCW Payout", -50.0, None, 100.0)]
    assert one(spark, parsers.quarter_end(F.lit("April - June 2026"))) == dt.date(2026, 6, 30)


def test_thinning_keeps_ends_and_extremes():
    v = np.sin(np.arange(1000) / 30)
    v[777] = 9
    kept = series.largest_triangles(v, 50)
    assert {0, 777, 999} <= set(kept) and len(kept) <= 52 and list(kept) == sorted(set(kept))


def test_stream_and_batch_agree(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, i % 5, i % 60), i % 7, ("click", "view")[i % 2], float(i)) for i in range(200)]
    batch = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    batch.write.parquet(str(tmp_path / "e"))
    query = activity.run_to_memory(activity.activity(activity.read_events(spark, str(tmp_path / "e"), batch.schema)), "seen")
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.sql("select * from seen").collect())) == sorted(map(tuple, activity.activity(batch).collect()))


def test_adjusted_prices_of_every_kind_of_fund(spark):
    from datetime import date

    from navloom.operators import nav

    day = lambda m: date(2024, m, 1)
    series = {1: [10, 11, 12, 13], 2: [10, 9, 9.5, 9], 3: [None, 20, 20, 22], 4: [110, 11, 11, 11], 5: [8, 8, 8, 8], 6: [5, 6, 7, 8], 7: [3, 3, 3, 3]}
    navs = spark.createDataFrame([(s, day(n + 1), None if v is None else float(v)) for s, vs in series.items() for n, v in enumerate(vs) if not (s == 1 and n == 0)], "scheme_id int, nav_date date, nav double")
    schemes = [(1, "a", "direct", "growth"), (2, "a", "direct", "idcw"), (3, "b", "direct", "growth"), (4, "b", "regular", "idcw_payout"), (5, None, "direct", "idcw"), (6, "c", "direct", "idcw"), (7, "c", "direct", "growth"), (8, "c", "regular", "growth")]
    payouts = spark.createDataFrame([(6, day(1), 1.0), (6, day(3), 2.0), (6, day(4), 9.0)], "scheme_id int, nav_date date, amount double")
    got = {}
    for r in nav.adjusted_prices(navs, payouts, spark.createDataFrame(schemes, "scheme_id int, family string, plan string, option string")).orderBy("nav_date").collect():
        got.setdefault(r.scheme_id, []).append((r.nav_adj, r.basis))
    assert got[1] == [(11.0, "own"), (12.0, "own"), (13.0, "own")]
    # The sibling's first price is of the second day; before it the fund's own counts.
    assert got[2] == [(10.0, "own"), (9.0, "sibling"), (round(9 * 12 / 11, 6), "sibling"), (round(9 * 13 / 11, 6), "sibling")]
    # A tenfold change of unit is no loss; the family has growth in the other plan only.
    assert got[4] == [(11.0, "own"), (11.0, "sibling"), (11.0, "sibling"), (12.1, "sibling")]
    assert got[5] == [(8.0, "own")] * 4 and got[7] == [(3.0, "own")] * 4 and [v for v, _ in got[3]] == [20.0, 20.0, 22.0]
    # No price before the first payout, and none that could pay the last.
    assert got[6] == [(5.0, "payouts"), (6.0, "payouts"), (10.5, "payouts"), (12.0, "payouts")]
