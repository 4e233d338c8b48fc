"""Queries and operators over whole inputs, against brute force."""

from __future__ import annotations

import datetime as dt
import random
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from navloom.functions import text as T
from navloom.operators import fund, ledger, resolve

TEXTS = [
    "alpha beta gamma delta epsilon zeta one two three four five six",
    "alpha beta gamma delta epsilon zeta seven eight nine ten eleven twelve",
    "other words at first here now one two three four five six",
    "other words at first here now one two three four five sixes",
    "an far longest of all keys",
    "tie good also even",
    "",
]


def benchmark(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_fuzzy_matches_use_whole_texts(spark, tmp_path):
    d = benchmark(spark, tmp_path)
    got = {(r.name_id, r["rank"]): (r.issuer_id, round(r.score, 9), r.accepted) for r in entry.queries()["fuzzy_best_matches"](spark, d).collect()}
    names = [r.x for r in spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").orderBy("i").select(T.normalise_name(F.col("t")).alias("x")).collect()]
    want = {}
    for i, a in enumerate(names):
        x, scored = set(a.split()), []
        for j, b in enumerate(names):
            y = set(b.split())
            if x & y:
                score, share = resolve.set_ratio(a, b), len(x & y) / len(x | y)
                scored.append((-score, j, share))
        want |= {(i, k): (j, round(-s, 9), -s >= 92 and share >= 0.7) for k, (s, j, share) in enumerate(sorted(scored)[:5], 1)}
    assert got == want
    assert {(i, j) for (i, _), (j, _, ok) in got.items() if ok and i < j} == {(2, 3)}


def test_longest_key_of_any_length(spark, tmp_path):
    d = benchmark(spark, tmp_path)
    got = {r.item_id: r.key for r in entry.queries()["benchmark_match_longest"](spark, d).collect()}
    bodies = [re.sub("[^a-z0-9]+", " ", t.lower()).strip() for t in TEXTS]
    keys = {" ".join(w[i : i + n]) for w in map(str.split, bodies) for n in (1, 2) for i in range(len(w) - n + 1)}
    want = {}
    for i, b in enumerate(bodies):
        hits = [k for k in keys if f" {k} " in f" {b} "]
        longest = [k for k in hits if len(k) == max(map(len, hits))]
        want[i] = longest[0] if len(longest) == 1 else None
    assert got == want and got[4] == "far longest"


def test_live_funds_without_a_family_and_regular_plans(spark):
    day = dt.date(2024, 1, 31)
    rows = [(1, 7, None, "growth", "direct"), (2, 7, None, "payout", "direct"), (3, 7, "x", "payout", "direct"), (4, 7, "x", "growth", "direct"), (0, 7, "x", "growth", "regular"), (5, 8, "x", "payout", "direct"), (6, 8, None, "growth", "regular")]
    funds = spark.createDataFrame(rows, "scheme_id int, amc_id int, family string, option string, plan string")
    seen = spark.createDataFrame([(r[0], day) for r in rows], "scheme_id int, nav_date date")
    assert sorted(r.scheme_id for r in fund.live_funds(funds, seen).collect()) == [1, 2, 4, 5]


def test_switches_with_unpaired_legs(spark):
    r, day = random.Random(2), dt.date(2024, 1, 2)
    legs = [(1, 50.0, "OUT"), (2, 100.0, "OUT"), (3, 200.0, "OUT"), (4, -100.0, "IN"), (5, -200.0, "IN")]
    rows = [(1, "f", day, ref, f"SWITCH_{k}", a) for ref, a, k in legs]
    rows += [(2, r.choice("gh"), day, 100 + i, r.choice(["SWITCH_OUT", "SWITCH_IN"]), round(r.uniform(1, 9), 1)) for i in range(60)]
    got = {(x.out_ref, x.in_ref) for x in ledger.link_switches(spark.createDataFrame(rows, "user_id int, folio string, txn_date date, txn_ref int, txn_type string, amount double")).collect()}
    taken, want = set(), set()
    for o in (x for x in rows if x[4] == "SWITCH_OUT"):
        for i in (x for x in rows if x[4] == "SWITCH_IN"):
            if i[3] not in taken and i[:3] == o[:3] and round(abs(abs(o[5]) - abs(i[5])), 6) <= 1:
                taken.add(i[3])
                want.add((o[3], i[3]))
                break
        else:
            want.add((o[3], None))
    assert got == want and {(2, 4), (3, 5)} <= got


def test_charges_stand_between_the_legs_of_a_switch(spark):
    day = dt.date(2024, 1, 2)
    rows = [(1, "f", day, 1, "STP_OUT", 1000.0, 10.0, 1.0, None), (1, "f", day, 2, "STP_IN", 988.5, None, None, 0.5), (1, "f", day, 3, "SWITCH_IN", 1000.0, None, None, 0.0), (1, "f", day, 4, "SWITCH_OUT", None, None, None, None)]
    docs = spark.createDataFrame(rows, "user_id int, folio string, txn_date date, txn_ref int, txn_type string, amount double, exit_load double, stt double, stamp_duty double")
    assert sorted(tuple(x)[3:] for x in ledger.link_switches(docs).collect()) == [(1, 2), (4, None)]


def test_each_reversal_takes_the_latest_that_is_left(spark):
    r = random.Random(5)
    rows = [(1, "f", 9, dt.date(2024, 1, 1), 1, "SIP", 5.0), (1, "f", 9, dt.date(2024, 1, 1), 2, "SIP", 5.0), (1, "f", 9, dt.date(2024, 1, 3), 3, "REVERSAL", -5.0), (1, "f", 9, dt.date(2024, 1, 3), 4, "REVERSAL", -5.0), (1, "f", 9, dt.date(2024, 1, 3), 5, "REVERSAL", None)]
    rows += [(2, r.choice("gh"), 9, dt.date(2024, 1, 1) + dt.timedelta(r.randint(0, 120)), 100 + i, r.choice(["SIP", "SIP", "REVERSAL"]), 0.0) for i in range(200)]
    rows = [(*x[:6], (-1 if x[5] == "REVERSAL" else 1) * float(r.randint(1, 3))) if x[6] == 0.0 else x for x in rows]
    schema = "user_id int, folio string, scheme_id int, txn_date date, txn_ref int, txn_type string, units double"
    got = {x.reversal_ref: x.txn_ref for x in ledger.link_reversals(spark.createDataFrame(rows, schema)).collect()}
    want, claimed = {}, set()
    for v in sorted((x for x in rows if x[5] == "REVERSAL"), key=lambda x: (x[3], x[4])):
        fits = [x for x in rows if x[5] != "REVERSAL" and x[4] not in claimed and x[:3] == v[:3] and v[6] is not None and 0 <= (v[3] - x[3]).days <= 30 and abs(x[6] + v[6]) < 1e-6]
        best = max(fits, key=lambda x: (x[3], x[4]), default=None)
        want[v[4]] = best and best[4]
        claimed |= {best[4]} if best else set()
    assert got == want and {got[3], got[4], got[5]} == {1, 2, None}
