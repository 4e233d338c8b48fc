"""Faults found on larger tables: rows of nothing, small rows under a subtotal, figures that round to zero."""

from __future__ import annotations

from decimal import Decimal as D

from pyspark.sql import functions as F

from navloom.functions.shown import pct_text, return_text
from navloom.operators import lots
from navloom.sources import sheets
from tests.test_lots import row, run


def test_an_opening_of_nothing_stops_no_book(spark):
    rows = [row("1", "2024-01-01", "PURCHASE", "10", "100"), row("2", "2024-01-02", "SIP", "0", "0"), row("3", "2024-02-01", "REDEMPTION", "-4", "50")]
    events = run(spark, rows).cache()
    assert lots.problems(events).count() == 0
    assert [(r.close_ref, r.used) for r in lots.consumptions(events).collect()] == [("3", D(4))]
    assert [r.lot_ref for r in lots.all_lots(events).collect()] == ["1"]
    # Money without units is no such row.
    paid = run(spark, [row("1", "2024-01-01", "PURCHASE", "0", "100")])
    assert [r.reason for r in lots.problems(paid).collect()] == ["no units or no scheme"]


def test_a_subtotal_covers_small_rows_at_its_end():
    values = [D("10000000.5"), D("6000000"), D("4000000"), D("0.5")]
    assert sheets._totalled([""] * 4, [None, D(1), D(1), D(1)], values) == {0: 3}
    # Within the room but not exact; then with a negative row.
    assert sheets._totalled([""] * 4, [None, D(1), D(1), D(1)], [D("10000001"), *values[1:]]) == {0: 3}
    assert sheets._totalled([""] * 5, [None, *[D(1)] * 4], [D("9999998.5"), D("6000000"), D("4000000"), D("-2"), D("0.5")]) == {0: 4}


def test_what_rounds_to_zero_is_no_loss(spark):
    got = spark.range(1).select(return_text(F.lit(-0.0004), F.lit(True)).alias("a"), return_text(F.lit(-0.0006), F.lit(True)).alias("b"), pct_text(F.lit(-0.04), 1, True).alias("c"), pct_text(F.lit(-0.04)).alias("d")).first()
    assert tuple(got) == ("+0.0% p.a.", "-0.1% p.a.", "+0.0%", "0.0%")
