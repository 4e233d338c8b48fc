"""Published lists, backfill plans and a fund's page, on small cases worked out by hand."""

from __future__ import annotations

import json
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from navloom.functions.text import isin_check_digit
from navloom.operators import backfill, fund_view
from navloom.sources import lists

ROWS = [{"Index Name": "Nifty 50 ", "Date": "28 MAR 2024", "TotalReturnsIndex": "32,851.27", "NTR_Value": "-"}, {"Index Name": "Nifty 50", "Date": "1 Apr 2024", "TotalReturnsIndex": 33000.5, "NTR_Value": "29,000.1"}]


def files(spark, texts):
    return spark.createDataFrame(list(texts.items()), "file_id string, content string")


def test_levels_in_every_envelope(spark):
    plain = json.dumps(ROWS)
    texts = {"list": plain, "under": json.dumps({"d": ROWS}), "text": json.dumps({"d": plain}), "mark": "\ufeff" + plain, "inner": json.dumps(plain), "none": "[]"}
    got = {}
    for r in lists.index_levels(files(spark, texts)).collect():
        got.setdefault(r.file_id, []).append((r.row_number, r.index_name, str(r.level_date), float(r.level), None if r.net_level is None else float(r.net_level)))
    want = [(1, "Nifty 50", "2024-03-28", 32851.27, None), (2, "Nifty 50", "2024-04-01", 33000.5, 29000.1)]
    assert got == {k: want for k in texts if k != "none"}


def test_a_bad_row_refuses_its_file(spark):
    bad = {
        "missing": [{"Index Name": "x", "Date": "1 Apr 2024"}], "day": [ROWS[0], ROWS[0] | {"Date": "31 Feb 2024"}], "month": [ROWS[0] | {"Date": "28 Mrz 2024"}],
        "level": [ROWS[0] | {"TotalReturnsIndex": "n/a"}], "net": [ROWS[0] | {"NTR_Value": "soon"}], "null": [ROWS[0] | {"TotalReturnsIndex": None}],
    }
    texts = {k: json.dumps(v) for k, v in bad.items()} | {"html": "<html>", "object": "{}", "empty": "", "number": "7", "good": json.dumps(ROWS)}
    staged = {(r.file_id, r.row_number): r.problem for r in lists.staged_levels(files(spark, texts)).collect() if r.problem}
    assert staged == {
        ("missing", 1): "missing TotalReturnsIndex", ("day", 2): "unreadable day 31 Feb 2024", ("month", 1): "unreadable day 28 Mrz 2024", ("level", 1): "unreadable level n/a", ("net", 1): "unreadable net level soon",
        ("null", 1): "unreadable level null", ("html", 0): "no list of rows", ("object", 0): "no list of rows", ("empty", 0): "no list of rows", ("number", 0): "no list of rows",
    }
    assert {r.file_id for r in lists.index_levels(files(spark, texts), strict=False).collect()} == {"good"}
    with pytest.raises(Exception, match="unreadable level n/a"):
        lists.index_levels(files(spark, {"level": texts["level"]})).collect()


def test_market_values(spark):
    codes = [r.c for r in spark.range(300).select(F.concat(F.lit("INE"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("b")).select(F.concat("b", isin_check_digit(F.col("b")).cast("string")).alias("c")).orderBy("b").collect()]
    head = ["Sr", "Company Name", "ISIN", "BSE 6 month avg", "NSE 6 month avg", "Categorization"]
    rows = [(0, ["Average Market Capitalization"]), (1, head), (2, ["", "", "", "5", "", ""]), (3, ["1", "Bad", "INE000", "5", "", ""]), (4, ["2", "Quiet", codes[299], "", "-", "Small Cap"]), (5, ["3", "Twice", codes[1].lower(), "2,000", "4,000", "Mid Cap"]), (6, ["4", "Short", codes[0], "3000"])]
    rows += [(10 + n, [str(n), f"c{n}", codes[n], str(2000 - n), "", "small cap" if n == 298 else ""]) for n in range(2, 299)]
    cells = spark.createDataFrame([("f", "Average30Jun2026.xlsx", n, c) for n, c in rows], "file_id string, file_name string, row_number int, cells array<string>")
    got = {r.company_name: r for r in lists.market_values(cells).collect()}
    assert len(got) == 301 and {r.basis_date for r in got.values()} == {date(2026, 6, 30)}
    # Equal values rank by code: Short's comes before Twice's.
    assert (float(got["Twice"].market_cap), got["Twice"].rank, got["Short"].rank) == (3000.0, 2, 1)
    assert got["Twice"].problem == "stated mid, by rank large" and got["c298"].problem is None and got["c298"].bucket == "small"
    assert (got["c101"].rank, got["c101"].bucket, got["c102"].rank, got["c102"].bucket) == (102, "mid", 103, "mid") and got["c99"].bucket == "large"
    assert got["Quiet"].market_cap is None and got["Quiet"].rank is None and got["Quiet"].bucket is None and got["Quiet"].problem is None
    assert got["Bad"].isin is None and got["Bad"].problem == "not a valid ISIN: INE000"
    with pytest.raises(Exception, match="no day in file name"):
        lists.market_values(cells.withColumn("file_name", F.lit("list.xlsx"))).collect()


def test_years_of_a_range(spark):
    day = date.fromisoformat
    ranges = spark.createDataFrame([(1, day("2023-11-05"), day("2025-02-01")), (2, day("2024-03-01"), day("2024-03-01")), (3, None, day("2024-01-01"))], "id int, a date, b date")
    got = [(r.id, str(r.chunk_start), str(r.chunk_end)) for r in backfill.year_chunks(ranges, "a", "b").orderBy("id", "chunk_start").collect()]
    assert got == [(1, "2023-11-05", "2023-12-31"), (1, "2024-01-01", "2024-12-31"), (1, "2025-01-01", "2025-02-01"), (2, "2024-03-01", "2024-03-01")]
    with pytest.raises(Exception, match="ends before it starts"):
        backfill.year_chunks(ranges.select("id", F.col("b").alias("a"), F.col("a").alias("b")), "a", "b").collect()


def test_histories_worth_asking_for(spark):
    today, start = date(2026, 7, 31), date(2026, 1, 1)
    whole = [start + timedelta(n) for n in range(200)]
    days = {1: whole, 2: [d for d in whole if not date(2026, 6, 25) < d < date(2026, 7, 5)], 3: whole[:100], 4: whole[:100], 5: whole[90:], 7: [d for d in whole if not date(2026, 6, 25) < d < date(2026, 7, 5)]}
    navs = spark.createDataFrame([(s, d) for s, ds in days.items() for d in ds], "scheme_id int, nav_date date")
    fetched = {4: today - timedelta(29), 5: today - timedelta(30), 7: today}
    schemes = spark.createDataFrame([(s, start, fetched.get(s)) for s in range(1, 8)], "scheme_id int, inception date, fetched date")
    at = F.lit(today)
    got = {r.scheme_id: r.reason for r in backfill.short_histories(schemes, navs, at).collect()}
    assert got == {2: "a 10-day gap in the last month", 3: "behind the newest daily file", 5: "starts after the fund's launch", 6: "no prices", 7: "a 10-day gap in the last month"}
    assert {r.scheme_id for r in backfill.short_histories(schemes, navs.filter("false"), at).collect()} == set(range(1, 8))


def navs_of(spark, series):
    return spark.createDataFrame([(s, date.fromisoformat(d), float(v)) for s, rows in series.items() for d, v in rows], "scheme_id int, nav_date date, nav double")


def test_falls_within_windows(spark):
    navs = navs_of(spark, {1: [("2018-01-31", 10), ("2019-01-31", 20), ("2019-07-31", 20), ("2020-01-31", 10), ("2021-01-31", 21), ("2021-06-30", 14.7), ("2022-01-31", 20)], 2: [("2021-01-31", 5), ("2021-02-28", 6)]})
    got = {(r.scheme_id, r.window): (round(r.depth, 6), r.peak and str(r.peak), r.trough and str(r.trough), r.recovery_days) for r in fund_view.window_falls(navs).collect()}
    assert got[1, "since_first_nav"] == (-0.5, "2019-01-31", "2020-01-31", 366)
    assert got[1, "1y"] == (-0.3, "2021-01-31", "2021-06-30", None) and got[1, "3y"][0] == -0.5
    assert got[2, "since_first_nav"] == (0.0, None, None, None)


def test_strip_of_funds_with_and_without_history(spark):
    navs = navs_of(spark, {1: [("2018-01-31", 10), ("2019-01-31", 12), ("2020-01-31", 11), ("2021-01-31", 13), ("2022-01-31", 16)], 2: [("2021-10-31", 5), ("2022-01-31", 6)]})
    levels = navs.filter("scheme_id = 1").select(F.col("nav_date").alias("level_date"), (F.col("nav") * 2 + 1).alias("level"))
    funds = spark.createDataFrame([(1, 5e9, date(2021, 12, 31), 0.7), (2, None, None, None), (3, None, None, None)], "scheme_id int, aum double, aum_as_of date, ter double").withColumn("ter_as_of", F.col("aum_as_of"))
    ranks = spark.createDataFrame([(1, 2, 12)], "scheme_id int, peer_rank int, n_peers int")
    got = {(r.scheme_id, r.tile): r for r in fund_view.header_strip(funds, navs, levels, ranks).collect()}
    assert [r.tile for r in sorted((r for r in got.values() if r.scheme_id == 1), key=lambda r: r.place)] == ["return_1y", "return_3y", "return_5y", "rank", "worst_fall", "volatility", "fund_size", "ter"]
    one = got[1, "return_1y"]
    assert one.value == pytest.approx(16 / 13 - 1) and one.tone == "ahead" and one.context == "Ahead of its benchmark, +22.2% p.a."
    assert got[1, "return_5y"].value is None and got[1, "return_5y"].context == "Less than 5 years of prices on record" and got[1, "return_5y"].tone is None
    assert got[1, "rank"].context == "2nd of 12" and got[2, "rank"].context == "—"
    assert got[1, "worst_fall"].context == "31 Jan 2019 to 31 Jan 2020; back at its high 366 days after the low"
    assert got[1, "volatility"].context == "Annualised, from 3 years of daily prices" and got[1, "fund_size"].context == "Quarterly average to 31 Dec 2021"
    assert {t for s, t in got if s == 2} == {t for s, t in got if s == 3} == {"return_1y", "return_3y", "return_5y", "rank", "fund_size", "ter"}
    places = spark.createDataFrame([(1.0, 0.0, 4.0), (9.0, 0.0, 4.0), (3.0, 3.0, 3.0)], "v double, low double, high double").select(fund_view.range_place(F.col("v"), F.col("low"), F.col("high")).alias("p")).collect()
    assert [r.p for r in places] == [25.0, 100.0, 50.0]
