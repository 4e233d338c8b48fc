"""Funds' disclosures in pages: whole pages or none, and what is said about those that look wrong."""

from __future__ import annotations

import json

from navloom.sources import disclosure_pages as P

STAMP = "2026-06-29T18:30:00.000Z"


def holding(**fields):
    return {"company_name": "Acme", "nature_name": "EQUITY", "instrument_name": "Equity", "market_value": 60, "corpus_per": 60.5, "portfolio_date": STAMP} | fields


def page(fund, attributes='type="application/json" id="__NEXT_DATA__"'):
    return f"<html>\n<script>var x;</script><script {attributes}>" + json.dumps({"props": {"pageProps": {"mfServerSideData": fund}}}) + "</script></html>"


def read(spark, pages):
    frame = spark.createDataFrame(list(pages.items()), "file_id string, html string")
    return {r.file_id: r for r in P.page_files(frame).collect()}, P.page_holdings(frame).orderBy("file_id", "row_number").collect()


def test_sections_and_values(spark):
    rows = [
        holding(), holding(company_name=" Net Payables ", nature_name="DEBT", instrument_name="Net Payables", market_value="-1,000.5", corpus_per=None), holding(instrument_name="Reverse Repo", nature_name="Equity"),
        holding(instrument_name="Repo-backed notes", nature_name="debt"), holding(instrument_name="Cash Futures"), holding(nature_name="PLEDGE", sector_name="", rating="AAA"), holding(nature_name=None, market_value=None), holding(nature_name="mf"),
    ]
    files, got = read(spark, {"a": page({"scheme_name": "Fund A", "aum": "-700.5", "holdings": rows})})
    assert [r.section for r in got] == ["EQUITY & EQUITY RELATED", "CASH & CASH EQUIVALENT", "CASH & CASH EQUIVALENT", "DEBT INSTRUMENTS", "DERIVATIVES", "PLEDGE", None, "MUTUAL FUND UNITS"]
    # 18:30 in universal time is the next day where the fund is.
    assert {str(r.as_of) for r in got} == {"2026-06-30"} and got[1].name == "Net Payables" and float(got[1].market_value) == -1000.5 and got[1].pct is None and got[6].market_value is None
    assert got[5].sector is None and got[5].rating == "AAA" and [r.row_number for r in got] == list(range(1, 9))
    assert files["a"].problem is None and files["a"].warnings == ["holdings off the stated total by -8.5653%", "natures without a section: PLEDGE"]


def test_pages_refused_as_wholes(spark):
    good = {"scheme_name": "F", "aum": 60.2, "holdings": [holding()]}
    pages = {
        "good": page(good), "stated": page(good | {"aum": 0}), "tag": page(good, 'id="other"'), "html": "no page", "null": None, "broken": '<script id="__NEXT_DATA__">{"props": </script>', "fund": '<script id="__NEXT_DATA__">{"props": {}}</script>',
        "none": page(good | {"holdings": []}), "object": page(good | {"holdings": {"a": 1}}), "name": page(good | {"holdings": [holding(), holding(company_name="  ")]}), "undated": page(good | {"holdings": [holding(portfolio_date=None)]}),
        "two": page(good | {"holdings": [holding(), holding(portfolio_date="2026-05-31")]}), "day": page(good | {"holdings": [holding(portfolio_date="June")]}), "zone": page(good | {"holdings": [holding(portfolio_date="2026-06-30T01:00:00+05:30")]}),
    }
    files, got = read(spark, pages)
    assert {k: f.problem for k, f in files.items() if f.problem} == {
        "tag": "no data in the page", "html": "no data in the page", "null": "no data in the page", "broken": "no fund in the data", "fund": "no fund in the data", "none": "no holdings", "object": "no holdings",
        "name": "no name in holding 2", "undated": "no date on any holding", "two": f"several dates: 2026-05-31, {STAMP}", "day": "unreadable date June",
    }
    assert {(r.file_id, str(r.as_of)) for r in got} == {("good", "2026-06-30"), ("stated", "2026-06-30"), ("zone", "2026-06-30")}
    assert files["good"].warnings == [] and files["stated"].warnings == ["no total stated"]
