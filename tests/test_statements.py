from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from navloom.operators import imports, lots
from navloom.sources import statements as S

# An invented statement in the layout that registrars print, with the traps that such statements hold.
TEXT = """
                          CONSOLIDATED ACCOUNT STATEMENT
                            01-Apr-2024 To 31-Mar-2025
PAN: XXXXX0000X                              Email: someone@example.invalid

Folio No: 4455667 / 12
Alpha Mutual Fund
ALPH01-Alpha Flexi Cap Fund - Growth - Direct Plan - ISIN: INF111A01AB2 (Advisor: ARN-0000)
        Opening Unit Balance: 120.500000
01-Apr-2024   Systematic Investment Purchase        10,000.00        5.695540     1,755.672000      126.195540
              *** Stamp Duty *** 0.50
20-Apr-2024   Rejected - SIP Purchase                10,000.00       (5.695540)    1,755.672000      120.500000
15-MAY-2024   Purchase                            1,23,456.78       68.590417     1,799.823000      189.090417
              *** Stamp Duty *** 6.17
                          CONSOLIDATED ACCOUNT STATEMENT
Page 2 of 3
ALPH01-Alpha Flexi Cap Fund - Growth - Direct Plan – ISIN: INF111A01AB2 (Advisor: ARN-0000)
10-Jun-2024   Switch Out - Alpha Balanced   56,486.79      (30.000000)    1,882.893000      159.090417
              *** Exit Load *** 564.87
12-Jun-2024   Purchase Instalment No. 7     1,000.00    0.500000   2,000.000000   159.590417
        Closing Unit Balance: 159.590417
ALPH02-Alpha Balanced Fund - Growth - Direct Plan - ISIN: INF111A01XA5
        Opening Unit Balance: 0.000000
10-Jun-2024   Switch In - From Alpha Flexi        55,921.92      109.144552       512.340000      109.144552
              *** Stamp Duty *** 2.80
        Closing Unit Balance: 109.144552
Folio No: 998877 / 01
Beta Mutual Fund
BETA01-Beta Bluechip Fund - IDCW Option - Regular Plan - ISIN: INF222B01BL4
        Opening Unit Balance: 500.000000
12-Aug-2024   IDCW Payout                             1,250.00                                       500.000000
14-Aug-2024   IDCW Payout per unit 2.50               1,250.00                                       500.000000
05-Sep-2024   Consolidation Adjustment Entry             0.00        0.000000       291.440000      500.000000
06-Sep-2024   Purchase with a column missing 100.00 7.000000 510.000000
31-Feb-2024   Purchase   100.00  1.000000  100.000000  501.000000
a line that means nothing here
        Closing Unit Balance: 500.000000
Portfolio Summary
Alpha Flexi Cap Fund - Growth - Direct Plan - ISIN: INF111A01AB2
10-Jun-2024   Switch Out - Alpha Balanced   56,486.79      (30.000000)    1,882.893000      159.090417
        Closing Unit Balance: 159.090417
Total Value                                        1,68,235.44
"""


@pytest.fixture(scope="module")
def read(spark):
    return S.read_statement(spark.createDataFrame([("u1", i, x) for i, x in enumerate(TEXT.splitlines())], "file string, line_no int, line string")).cache()


def schemes(spark):
    return spark.createDataFrame([("INF111A01AB2", "A"), ("INF111A01XA5", "B")], "isin string, scheme_id string")


def test_every_trap_is_read(read):
    rows = S.transactions(read).orderBy("line_no").collect()
    number = lambda x: None if x is None else float(x)
    assert [(r.folio, r.isin[-3:], str(r.txn_date), r.description, number(r.amount), number(r.units), number(r.balance), number(r.stamp_duty), number(r.exit_load)) for r in rows] == [
        ("4455667/12", "AB2", "2024-04-01", "Systematic Investment Purchase", 10000.0, 5.69554, 126.19554, 0.5, 0.0),
        ("4455667/12", "AB2", "2024-04-20", "Rejected - SIP Purchase", 10000.0, -5.69554, 120.5, 0.0, 0.0),
        ("4455667/12", "AB2", "2024-05-15", "Purchase", 123456.78, 68.590417, 189.090417, 6.17, 0.0),
        ("4455667/12", "AB2", "2024-06-10", "Switch Out - Alpha Balanced", 56486.79, -30.0, 159.090417, 0.0, 564.87),
        ("4455667/12", "AB2", "2024-06-12", "Purchase Instalment No. 7", 1000.0, 0.5, 159.590417, 0.0, 0.0),
        ("4455667/12", "XA5", "2024-06-10", "Switch In - From Alpha Flexi", 55921.92, 109.144552, 109.144552, 2.8, 0.0),
        ("998877/01", "BL4", "2024-08-12", "IDCW Payout", 1250.0, None, 500.0, 0.0, 0.0),
        ("998877/01", "BL4", "2024-08-14", "IDCW Payout per unit 2.50", 1250.0, None, 500.0, 0.0, 0.0),
        ("998877/01", "BL4", "2024-09-05", "Consolidation Adjustment Entry", 0.0, 0.0, 500.0, 0.0, 0.0),
    ]
    assert [r.solved for r in rows] == [False] * 4 + [True, False, False, True, False]
    assert [r.line.split()[0] for r in read.filter("role = 'unparsed'").orderBy("line_no").collect()] == ["06-Sep-2024", "31-Feb-2024", "a"]
    balances = [(r.role, r.isin[-3:], float(r.balance)) for r in read.filter("role in ('opening', 'closing')").orderBy("line_no").collect()]
    assert balances == [("opening", "AB2", 120.5), ("closing", "AB2", 159.590417), ("opening", "XA5", 0.0), ("closing", "XA5", 109.144552), ("opening", "BL4", 500.0), ("closing", "BL4", 500.0)]


def test_text_becomes_a_linked_ledger_once(spark, read):
    typed = imports.typed_rows(read, schemes(spark)).cache()
    nothing = spark.createDataFrame([], "txn_id string")
    new = imports.new_rows(typed, nothing).cache()
    rows = {(r.isin[-3:], r.txn_type, str(r.txn_date)): r for r in new.collect()}
    assert len(rows) == 8
    assert rows["BL4", "IDCW_PAYOUT", "2024-08-12"].flags == ["UNRESOLVED_SCHEME"]
    out, back = rows["AB2", "SWITCH_OUT", "2024-06-10"], rows["XA5", "SWITCH_IN", "2024-06-10"]
    assert out.switch_group_id == back.switch_group_id is not None
    assert (float(out.amount), float(back.amount)) == (56486.79, -55919.12)
    assert rows["AB2", "REVERSAL", "2024-04-20"].reverses_id == rows["AB2", "SIP", "2024-04-01"].txn_id
    assert float(rows["AB2", "PURCHASE", "2024-05-15"].amount) == -123450.61
    report = imports.import_report(read, typed, nothing).first()
    assert tuple(report) == ("u1", 8, 0, 1, 3, "partial")
    stored = new.select("txn_id")
    assert imports.new_rows(typed, stored).count() == 0
    assert tuple(imports.import_report(read, typed, stored).first()) == ("u1", 0, 8, 1, 3, "partial")


def test_ids_do_not_depend_on_where_a_statement_begins(spark, read):
    lines = TEXT.splitlines()
    later = [x for x in lines if not x.startswith(("01-Apr-2024", "20-Apr-2024"))]
    again = S.read_statement(spark.createDataFrame([("u1", i, x) for i, x in enumerate(later)], "file string, line_no int, line string"))
    ids = {r.txn_id for r in imports.typed_rows(read, schemes(spark)).collect()}
    part = {r.txn_id for r in imports.typed_rows(again, schemes(spark)).collect()}
    assert part < ids and len(ids - part) == 2


def test_from_text_to_lots(spark, read):
    new = imports.new_rows(imports.typed_rows(read, schemes(spark)), spark.createDataFrame([], "txn_id string")).cache()
    opening = spark.createDataFrame([("u1", "4455667/12", "A", "opening", date(2020, 1, 1), 0, "PURCHASE", -100000.0, 120.5)], "user_id string, folio string, scheme_id string, txn_ref string, txn_date date, txn_seq int, txn_type string, amount double, units double")
    rows = imports.ledger_rows(new).unionByName(opening, allowMissingColumns=True)
    events = lots.lot_events(lots.prepared(rows))
    assert lots.problems(events).collect() == []
    left = {r["scheme_id"]: float(r["u"]) for r in lots.all_lots(events).groupBy("scheme_id").agg(F.sum("units_left").alias("u")).collect()}
    assert left == {"A": 159.590417, "B": 109.144552}
    # Without the units that were there before, the book can't give what it sells.
    short = lots.problems(lots.lot_events(lots.prepared(imports.ledger_rows(new).filter("txn_date < '2024-05-01' or txn_type = 'SWITCH_OUT'")))).collect()
    assert [(p.reason, float(p.short)) for p in short] == [("more units than the book holds", 30.0)]


def test_dates_that_do_not_exist(spark):
    said = spark.createDataFrame([("01-jan-2024",), ("29-Feb-2023",), ("10-anf-2024",), ("31-DEC-1999",)], "t string")
    assert [r[0] for r in said.select(S.printed_date(F.col("t"))).collect()] == [date(2024, 1, 1), None, None, date(1999, 12, 31)]
