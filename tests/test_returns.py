"""Returns of positions and reconciliation of books, on books worked out by hand."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from navloom.operators import lots, returns

TXN = "user_id int, folio string, scheme_id int, txn_date date, txn_ref int, txn_type string, units decimal(20,6), amount decimal(20,4), exit_load decimal(10,4), stt decimal(10,4)"


def row(ref, day, kind, units, amount, scheme=1, load=None, stt=None, folio="f"):
    return (1, folio, scheme, date.fromisoformat(day), ref, kind, Decimal(units), None if amount is None else Decimal(amount), load and Decimal(load), stt and Decimal(stt))


def navs(spark, rows):
    return spark.createDataFrame([(s, date.fromisoformat(d), float(n)) for s, d, n in rows], "scheme_id int, nav_date date, nav double")


def positions(spark, rows):
    kind = "user_id int, folio string, scheme_id int, units decimal(20,6), as_of date, first_purchase date, invested_net decimal(20,4)"
    return spark.createDataFrame([(1, "f", s, Decimal(u), date.fromisoformat(a), date.fromisoformat(f), Decimal(n)) for s, u, a, f, n in rows], kind)


def test_figures_of_positions(spark):
    rows = [
        row(1, "2021-01-01", "PURCHASE", 100, 1000), row(2, "2023-01-01", "SIP", 100, 2000),
        row(3, "2024-06-01", "PURCHASE", 10, 100, scheme=2), row(4, "2021-01-01", "PURCHASE", 10, 100, scheme=3),
        row(5, "2022-01-01", "PURCHASE", 10, 100, scheme=4), row(6, "2022-03-01", "REDEMPTION", 9, 500, scheme=4), row(7, "2025-06-01", "PURCHASE", 50, 500),
    ]
    prices = navs(spark, [(1, "2020-12-31", 10), (1, "2023-01-01", 20), (1, "2024-12-30", 20), (2, "2024-06-01", 10), (2, "2025-01-01", 11), (4, "2021-12-31", 10), (4, "2024-12-31", 12), (1, "2025-06-01", 90)])
    asked = [(1, 200, "2025-01-01", "2021-01-01", 3000), (2, 10, "2025-01-01", "2024-06-01", 100), (3, 10, "2025-01-01", "2021-01-01", 100), (4, 1, "2025-01-01", "2022-01-01", -400)]
    got = {r.scheme_id: r for r in returns.position_returns(positions(spark, asked), lots.prepared(spark.createDataFrame(rows, TXN)), prices).collect()}
    one = got[1]
    # Half of the money came after the price had doubled: the fund's yearly rate is higher than the investor's.
    assert one.market_value == 4000 and one.twrr_cum == pytest.approx(1.0) and one.twrr_annual == pytest.approx(2 ** (365 / 1461) - 1)
    worth = lambda rate: -1000 - 2000 / (1 + rate) ** (730 / 365) + 4000 / (1 + rate) ** (1461 / 365)
    assert abs(worth(one.xirr)) < 1e-5 and one.timing_effect == pytest.approx(one.xirr - one.twrr_annual) and one.timing_effect < 0
    assert one.absolute_return == pytest.approx(1 / 3) and one.note is None
    assert got[2].twrr_cum == pytest.approx(0.1) and got[2].twrr_annual is None and got[2].timing_effect is None and "under a year" in got[2].note
    assert got[3].market_value is None and got[3].xirr is None and got[3].absolute_return is None
    assert got[4].absolute_return is None and got[4].xirr is not None


def test_legs_of_switches_are_flows_of_a_position_only(spark):
    rows = lots.prepared(spark.createDataFrame([
        row(1, "2021-01-01", "PURCHASE", 10, 100), row(2, "2021-02-01", "SWITCH_OUT", 5, 60, load="1", stt="0.5"), row(3, "2021-02-01", "SWITCH_IN", 5, 58, scheme=2),
        row(4, "2021-03-01", "IDCW_REINVEST", 1, 10), row(5, "2021-03-01", "IDCW_PAYOUT", 0, 7), row(6, "2021-04-01", "SWP", 1, 12), row(7, "2021-05-01", "UNIT_SPLIT", 4, None),
    ], TXN))
    by_book = {(r.scheme_id, str(r.txn_date)): float(r.flow) for r in returns.external_flows(rows).collect()}
    assert by_book == {(1, "2021-01-01"): -100, (1, "2021-02-01"): 58.5, (2, "2021-02-01"): -58, (1, "2021-03-01"): 7, (1, "2021-04-01"): 12}
    whole = {str(r.txn_date): float(r.flow) for r in returns.external_flows(rows, portfolio=True).collect()}
    assert whole == {"2021-01-01": -100, "2021-03-01": 7, "2021-04-01": 12}


def book(spark, printed, held=None):
    """Printed rows of one scheme each: (scheme, day, units, balance, price)."""
    rows = [(1, "f", s, date.fromisoformat(d), 0, n, "PURCHASE", Decimal(u), None if b is None else Decimal(b), p) for n, (s, d, u, b, p) in enumerate(printed)]
    frame = spark.createDataFrame(rows, "user_id int, folio string, scheme_id int, txn_date date, txn_seq int, txn_ref int, txn_type string, units decimal(20,6), units_balance decimal(20,6), printed_nav double")
    own = frame.groupBy("user_id", "folio", "scheme_id").agg(F.sum("units").alias("units")) if held is None else spark.createDataFrame([(1, "f", s, Decimal(u)) for s, u in held], "user_id int, folio string, scheme_id int, units decimal(20,6)")
    return own, frame


def test_causes_of_a_difference(spark):
    day, later = "2021-01-04", "2021-06-01"
    printed = [
        (1, day, 10, "10", 10.0), (1, later, 5, "15", 10.04),
        (2, day, 10, "14", 10.0), (3, day, 10, "10", 10.0), (3, later, 5, "18", 10.0), (4, day, 10, "7", 10.0),
        (5, day, 10, "10", 11.0), (6, day, 10, "10", None), (7, day, 10, None, 10.0), (8, day, 10, "10", 10.0), (8, "2022-01-01", 5, "99", 10.0), (9, day, 10, "12", 11.0), (11, "2021-01-05", 10, "10", 10.0),
    ]
    drift = [(10, day, "1", str(n + 1), 10.0) for n in range(101)]
    drift[-1] = (10, day, "1", "101.004", 10.0)
    held = [(s, u) for s, u in ((1, 15), (2, 10), (3, 15), (4, 10), (5, 10), (6, 10), (7, 10), (8, 10), (9, 10), (10, 101), (11, 10))]
    prices = navs(spark, [(s, d, 10) for s in range(1, 12) for d in (day, later)])
    own, frame = book(spark, printed + drift, held)
    got = {r.scheme_id: (r.status, r.confidence, r.diagnosis) for r in returns.reconcile_books(own, frame, prices, F.lit("2021-12-31").cast("date")).collect()}
    assert got == {
        1: ("ok", "high", []), 2: ("fail", "low", ["MISSING_EARLY_CAS"]), 3: ("fail", "low", ["UNKNOWN"]), 4: ("fail", "low", ["MISSING_REDEMPTION"]),
        5: ("fail", "low", ["WRONG_NAV_SERIES", "LIKELY_PLAN_MISMATCH_DIRECT_VS_REGULAR"]), 6: ("warn", "medium", ["NAV_SERIES_UNVERIFIED"]), 7: ("warn", "medium", ["NO_REPORTED_BALANCE"]),
        8: ("ok", "high", []), 9: ("fail", "low", ["MISSING_EARLY_CAS", "WRONG_NAV_SERIES"]), 10: ("fail", "low", ["FLOAT_CONTAMINATION"]), 11: ("warn", "medium", ["NAV_SERIES_UNVERIFIED"]),
    }


def test_no_rows_and_no_positions(spark):
    own, frame = book(spark, [])
    assert returns.reconcile_books(own, frame, navs(spark, []), F.lit("2021-12-31").cast("date")).count() == 0
    assert returns.position_returns(positions(spark, []), lots.prepared(spark.createDataFrame([], TXN)), navs(spark, [])).count() == 0
