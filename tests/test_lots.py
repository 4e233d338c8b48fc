from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal as D

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from navloom.operators import lots
from navloom.streaming.lots import stream_lot_events

# A folio history at published prices, and what its lots, costs and gains must be.
HDFC, ICICI, KOTAK = "INF179K01UT0", "INF109K01761", "INF174KA1EZ1"
HISTORY = [
    ("T001", "F0001/22", HDFC, "2024-01-01", 0, "SIP", "6.131905", "1630.733000", "-9999.5000", "0.5", "0", "0", None),
    ("T002", "F0001/22", HDFC, "2024-02-01", 0, "SIP", "5.971220", "1674.616000", "-9999.5000", "0.5", "0", "0", None),
    ("T003", "F0001/22", HDFC, "2024-03-01", 0, "SIP", "5.752026", "1738.431000", "-9999.5000", "0.5", "0", "0", None),
    ("T004", "F0001/22", HDFC, "2024-04-01", 0, "SIP", "5.695540", "1755.672000", "-9999.5000", "0.5", "0", "0", None),
    ("T005", "F0001/22", HDFC, "2024-05-02", 0, "SIP", "5.555824", "1799.823000", "-9999.5000", "0.5", "0", "0", None),
    ("T006", "F0001/22", HDFC, "2024-06-03", 0, "SIP", "5.310711", "1882.893000", "-9999.5000", "0.5", "0", "0", None),
    ("T007", "F0001/22", HDFC, "2024-07-01", 0, "SIP", "5.083346", "1967.110000", "-9999.5000", "0.5", "0", "0", None),
    ("T008", "F0001/22", HDFC, "2024-07-05", 0, "REVERSAL", "-5.083346", "1967.110000", "9999.5000", "0", "0", "0", "T007"),
    ("T009", "F0001/22", HDFC, "2025-01-15", 0, "REDEMPTION", "-20.000000", "1970.698000", "39413.9600", "0", "0.3941", "273.2983", None),
    ("T010", "F0001/22", HDFC, "2026-01-16", 0, "SWITCH_OUT", "-10.000000", "2271.185000", "22711.8500", "0", "0.2271", "0", None),
    ("T011", "F0003/01", ICICI, "2026-01-16", 1, "SWITCH_IN", "27.773917", "817.691200", "-22710.4873", "1.1356", "0", "0", None),
    ("T012", "F0004/18", KOTAK, "2024-11-04", 0, "PURCHASE", "1567.516303", "31.896000", "-49997.5000", "2.5", "0", "0", None),
    ("T013", "F0004/18", KOTAK, "2025-08-01", 0, "PURCHASE", "726.686724", "34.401000", "-24998.7500", "1.25", "0", "0", None),
    ("T014", "F0004/18", KOTAK, "2026-04-15", 0, "REDEMPTION", "-1800.000000", "34.552000", "62193.6000", "0", "0.6219", "40.1639", None),
]
USED = {
    "T009": [("T001", "6.131905", 380, "LTCG", "10000.0000", "12000.2201", "2000.2201"), ("T002", "5.971220", 349, "STCG", "10000.0000", "11685.7574", "1685.7574"), ("T003", "5.752026", 320, "STCG", "10000.0000", "11256.7918", "1256.7918"), ("T004", "2.144849", 289, "STCG", "3765.8396", "4197.4983", "431.6587")],
    "T010": [("T004", "3.550691", 655, "LTCG", "6234.1604", "8064.1955", "1830.0351"), ("T005", "5.555824", 624, "LTCG", "10000.0000", "12618.1780", "2618.1780"), ("T006", "0.893485", 592, "LTCG", "1682.4207", "2029.2494", "346.8287")],
    "T014": [("T012", "1567.516303", 527, "LTCG", "50000.0000", "54125.3049", "4125.3049"), ("T013", "232.483697", 257, "STCG", "7998.0715", "8027.5093", "29.4378")],
}
OPENED = {
    "T001": ("sip", "10000.0000", "1630.814567"), "T002": ("sip", "10000.0000", "1674.699643"), "T003": ("sip", "10000.0000", "1738.517872"), "T004": ("sip", "10000.0000", "1755.759770"), "T005": ("sip", "10000.0000", "1799.913028"),
    "T006": ("sip", "10000.0000", "1882.987043"), "T012": ("purchase", "50000.0000", "31.897595"), "T013": ("purchase", "25000.0000", "34.402720"), "T011": ("switch_in", "22711.6229", "817.732079"),
}
SCHEMA = "txn_ref string, folio string, scheme_id string, txn_date date, txn_seq int, txn_type string, units decimal(20,6), nav decimal(20,6), amount decimal(20,4), stamp_duty decimal(20,4), stt decimal(20,4), exit_load decimal(20,4), reverses_ref string, source_scheme string"


def table(spark, rows):
    def whole(r):
        r = (*r, *[None] * (14 - len(r)))
        number = lambda x: None if x is None else D(x)
        return (*r[:3], date.fromisoformat(r[3]), *r[4:6], *map(number, r[6:12]), *r[12:])

    return spark.createDataFrame([whole(r) for r in rows], SCHEMA).withColumn("user_id", F.lit("USER-01"))


def run(spark, rows, **options):
    return lots.lot_events(lots.prepared(table(spark, rows), **options))


def row(ref, day, kind, units, amount=None, scheme="A", nav=None, source=None, seq=0, folio="F"):
    return (ref, folio, scheme, day, seq, kind, units, nav, amount, "0", "0", "0", None, source)


def test_published_history(spark):
    events = run(spark, HISTORY)
    used = lots.consumptions(events).orderBy("close_ref", "sequence").collect()
    got = {}
    for c in used:
        got.setdefault(c.close_ref, []).append((c.lot_ref, str(c.used), c.holding_days, c.gain_type, str(c.cost), str(c.net), str(c.gain)))
    assert got == USED
    opened = {x.lot_ref: (x.origin, str(x.cost), str(x.unit_cost)) for x in lots.all_lots(events).collect()}
    assert opened == OPENED
    left = {r["scheme_id"]: str(r["u"]) for r in lots.all_lots(events).groupBy("scheme_id").agg(F.sum("units_left").alias("u")).collect()}
    assert left == {ICICI: "27.773917", KOTAK: "494.203027", HDFC: "4.417226"}
    assert lots.problems(events).collect() == []


@pytest.mark.parametrize(("days", "kind"), [(364, "STCG"), (365, "STCG"), (366, "LTCG")])
def test_long_term_begins_after_365_days(spark, days, kind):
    sold = str(date(2023, 1, 2) + timedelta(days))
    assert lots.consumptions(run(spark, [row("a", "2023-01-02", "PURCHASE", "1", "10"), row("b", sold, "SWP", "-1", "11")])).first()["gain_type"] == kind


def test_merger_carries_days_and_cost_and_is_consumed_in_order_of_acquisition(spark):
    rows = [
        row("a", "2020-01-01", "PURCHASE", "100", "1000", "OLD"), row("b", "2022-01-01", "PURCHASE", "50", "900", "OLD"), row("c", "2023-01-01", "REDEMPTION", "-20", "400", "OLD"),
        row("d", "2021-06-01", "PURCHASE", "10", "500", "NEW"), row("m", "2023-06-01", "MERGER_IN", "65", "0", "NEW", source="OLD"), row("e", "2023-07-01", "REDEMPTION", "-60", "6000", "NEW"),
    ]
    events = run(spark, rows)
    used = [(c.lot_ref, str(c.acquired), float(c.used), float(c.cost)) for c in lots.consumptions(events).filter("close_ref = 'e'").orderBy("sequence").collect()]
    # 80 of the first lot become 40 at 800, 50 of the second 25 at 900; the target's own lot lies between them.
    assert used == [("a", "2020-01-01", 40.0, 800.0), ("d", "2021-06-01", 10.0, 500.0), ("b", "2022-01-01", 10.0, 360.0)]
    left = {(x.scheme_id, x.lot_ref): (float(x.units_left), float(x.cost_left), str(x.booked), x.origin) for x in lots.all_lots(events).collect() if x.units_left}
    assert left == {("NEW", "b"): (15.0, 540.0, "2023-06-01", "merger")}


def test_linked_mergers_carry_and_unlinked_ones_close_and_open(spark):
    base = table(spark, [row("a", "2020-01-01", "PURCHASE", "10", "100", "OLD"), row("o", "2021-01-01", "MERGER_OUT", "-10", "150", "OLD"), row("i", "2021-01-01", "MERGER_IN", "5", "-150", "NEW", seq=1)]).drop("source_scheme")
    linked = lots.with_sources(base.withColumn("switch_group_id", F.when(F.col("txn_type").startswith("MERGER"), "G")))
    events = lots.lot_events(lots.prepared(linked))
    assert lots.consumptions(events).count() == 0
    assert [(x.origin, str(x.acquired), float(x.cost)) for x in lots.all_lots(events).filter("units_left > 0").collect()] == [("merger", "2020-01-01", 100.0)]
    events = lots.lot_events(lots.prepared(lots.with_sources(base.withColumn("switch_group_id", F.lit(None).cast("string")))))
    assert [float(c.gain) for c in lots.consumptions(events).collect()] == [50.0]
    assert [(x.origin, str(x.acquired), float(x.cost)) for x in lots.all_lots(events).filter("units_left > 0").collect()] == [("merger", "2021-01-01", 150.0)]


def test_segregation_and_split(spark):
    rows = [
        row("a", "2020-01-01", "PURCHASE", "30", "300", "OLD"), row("b", "2021-01-01", "PURCHASE", "10", "500", "OLD"),
        row("s", "2022-01-01", "SEGREGATION", "40", "80", "SIDE", source="OLD"), row("u", "2022-02-01", "UNIT_SPLIT", "40", None, "OLD"),
    ]
    got = {(x.scheme_id, x.lot_ref): (str(x.acquired), float(x.units_left), float(x.cost_left), float(x.unit_cost)) for x in lots.all_lots(run(spark, rows)).collect()}
    assert got == {("OLD", "a"): ("2020-01-01", 60.0, 270.0, 4.5), ("OLD", "b"): ("2021-01-01", 20.0, 450.0, 22.5), ("SIDE", "a"): ("2020-01-01", 30.0, 30.0, 1.0), ("SIDE", "b"): ("2021-01-01", 10.0, 50.0, 5.0)}


@pytest.mark.parametrize(("bad", "reason", "short"), [
    (row("x", "2021-02-01", "REDEMPTION", "-11", "5"), "more units than the book holds", 1.0), (row("x", "2021-02-01", "PURCHASE", "0", "5"), "no units or no scheme", None),
    (row("x", "2021-02-01", "SIP", "3"), "no amount and no price", None), (row("x", "2021-02-01", "SEGREGATION", "3", "5"), "unhandled type SEGREGATION", None),
    (row("x", "2021-02-01", "MERGER_IN", "3", "5", source="none"), "no open lots to carry", None),
])
def test_refused_rows_stop_their_book_only(spark, bad, reason, short):
    rows = [row("a", "2021-01-01", "PURCHASE", "10", "100"), bad, row("y", "2021-03-01", "REDEMPTION", "-1", "5"), row("b", "2021-01-01", "PURCHASE", "10", "100", "B"), row("z", "2021-03-01", "REDEMPTION", "-1", "5", "B")]
    events = run(spark, rows)
    assert [(p.txn_ref, p.reason, p.short if p.short is None else float(p.short)) for p in lots.problems(events).collect()] == [("x", reason, short)]
    assert [c.close_ref for c in lots.consumptions(events).collect()] == ["z"]
    with pytest.raises(PythonException, match=reason):
        lots.lot_events(lots.prepared(table(spark, rows)), strict=True).collect()


def test_grandfathering_and_other_tax_classes(spark):
    rows = [row("a", "2017-01-01", "PURCHASE", "10", "100"), row("b", "2019-01-01", "REDEMPTION", "-4", "120", nav="30")]
    events = run(spark, rows, nav_2018=F.lit(25))
    assert [(float(c.cost), c.basis, c.confidence) for c in lots.consumptions(events).collect()] == [(100.0, "grandfathered", "high")]
    assert [float(x.cost_left) for x in lots.all_lots(events).collect()] == [60.0]
    assert [(c.basis, c.confidence) for c in lots.consumptions(run(spark, rows)).collect()] == [("actual", "low")]
    assert [p.reason for p in lots.problems(run(spark, rows, tax_class="debt")).collect()] == ["no holding period known for debt"]


def test_a_stream_in_three_batches_with_a_restart_equals_the_batch(spark, tmp_path):
    rows = lots.prepared(table(spark, HISTORY))
    source, cuts = str(tmp_path / "in"), ["2024-04-15", "2025-06-01", "2027-01-01"]
    want = {tuple(r) for r in lots.consumptions(lots.lot_events(rows)).collect()}

    def step(from_day, to_day):
        rows.filter((F.col("txn_date") > from_day) & (F.col("txn_date") <= to_day)).coalesce(1).write.mode("append").parquet(source)
        stream = stream_lot_events(spark.readStream.schema(rows.schema).parquet(source))
        # Each step is a new query on the same checkpoint: the books are recovered from it.
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    for a, b in zip(["2000-01-01", *cuts], cuts):
        step(a, b)
    assert {tuple(r) for r in lots.consumptions(spark.read.parquet(str(tmp_path / "out"))).collect()} == want
    lots.prepared(table(spark, [(*HISTORY[0][:3], "2023-01-01", *HISTORY[0][4:])])).coalesce(1).write.mode("append").parquet(source)
    step("2027-01-01", "2027-01-01")
    assert [p.reason for p in lots.problems(spark.read.parquet(str(tmp_path / "out"))).collect()] == ["dated before a row already applied"]
