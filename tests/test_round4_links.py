"""Links of reversals and switches go through sorted rows: many small groups and one large one."""

from __future__ import annotations

from datetime import date, timedelta

from navloom.operators import ledger


def test_groups_are_streamed(spark):
    day = date(2024, 1, 1)
    legs = [(1, "F", 1, n, "SWITCH_IN" if n % 2 else "SWITCH_OUT", day, 100.0 + n % 10 * 0.4, 1.0) for n in range(3000)]
    legs += [(2, str(n), 1, 10_000 + n, "STP_OUT", day, 5.0, 1.0) for n in range(500)]
    txns = spark.createDataFrame(legs, "user_id long, folio string, scheme_id long, txn_ref long, txn_type string, txn_date date, amount double, units double")
    linked = ledger.link_switches(txns)
    assert "FlatMapGroups" not in linked._jdf.queryExecution().executedPlan().toString()
    got = {r.out_ref: r.in_ref for r in linked.collect()}
    free, want = [(n, a) for _, _, _, n, k, _, a, _ in legs if k == "SWITCH_IN"], {}
    for _, _, _, n, kind, _, amount, _ in legs:
        if kind != "SWITCH_IN":
            hit = next((x for x in free if n < 10_000 and abs(round(x[1] * 10_000) - round(amount * 10_000)) <= 10_000), None)
            want[n] = hit and hit[0]
            if hit:
                free.remove(hit)
    assert got == want


def test_reversals_take_the_latest_open_row(spark):
    day = lambda n: date(2024, 1, 1) + timedelta(n)
    rows = [(1, "F", 1, 1, "SIP", day(0), 5.0), (1, "F", 1, 2, "SIP", day(3), 5.0), (1, "F", 1, 3, "REVERSAL", day(3), -5.0), (1, "F", 1, 4, "REVERSAL", day(30), -5.0), (1, "F", 1, 5, "REVERSAL", day(31), -5.0), (1, "G", 1, 6, "REVERSAL", day(1), -5.0), (1, "F", 1, 7, "REVERSAL", day(1), None)]
    linked = ledger.link_reversals(spark.createDataFrame(rows, "user_id long, folio string, scheme_id long, txn_ref long, txn_type string, txn_date date, units double"))
    assert "FlatMapGroups" not in linked._jdf.queryExecution().executedPlan().toString()
    assert {r.reversal_ref: r.txn_ref for r in linked.collect()} == {3: 2, 4: 1, 5: None, 6: None, 7: None}
