"""Mixing, sharding, exact dedup."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from navloom.llm import exact_dedup, mixing, sharding

TEXTS = ["a b c", "a  b\tc", "x", "x", None, "", " ", "long " * 5000, "A b c", "e f"]


def test_exact_dedup_matches_brute_force(make_docs):
    got = {r.doc_id: r for r in exact_dedup.duplicate_classes(make_docs(TEXTS, extra=True)).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in TEXTS]
    for i, t in enumerate(norm):
        same = [j for j, o in enumerate(norm) if o == t]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (same[0], len(same), i == same[0], hashlib.sha256(t.encode()).hexdigest())


def test_exact_dedup_result_does_not_depend_on_the_filter(make_docs):
    docs = make_docs([f"t{i % 700}" for i in range(1000)])
    one, two = (sorted(map(tuple, exact_dedup.duplicate_classes(docs, max_bits=b).collect())) for b in (1 << 15, 1 << 20))
    assert one == two and sum(r[3] for r in one) == 700


def test_exact_dedup_keeps_one_of_repeated_rows(spark, no_docs):
    docs = spark.createDataFrame([(3, "q", "m"), (3, "q", "n"), (None, "q", "o"), (None, "z", "p"), (8, "r", "u")], "doc_id long, text string, digest string")
    kept = exact_dedup.drop_duplicates(docs).collect()
    assert Counter(r.text for r in kept) == {"q": 1, "z": 1, "r": 1}
    assert next(r.doc_id for r in kept if r.text == "q") == 3
    assert exact_dedup.duplicate_classes(no_docs).count() == 0 and exact_dedup.drop_duplicates(no_docs).count() == 0


def filled(sizes, weights, total, cap=2):
    """Water level found by bisection."""
    low, high = 0.0, float(total)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(cap * s, mid * w) for s, w in zip(sizes, weights, strict=True)) < total else (low, mid)
    return [min(cap * s, low * w) for s, w in zip(sizes, weights, strict=True)]


def test_mix_reaches_its_targets(make_docs):
    texts = ["w " * (i % 17) for i in range(300)] + [None, ""]
    docs = make_docs(texts, source=lambda i: None if i % 10 == 0 else "hot" if i % 3 else f"s{i % 4}", extra=True)
    rows = mixing.mix_plan(docs).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size and (r.position is None) == (r.taken == 0)
    names = sorted((n for n in by if n is not None)) + [None]
    sizes = [sum(r.size for r in by[n]) for n in names]
    want = filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes))
    for n, size, target in zip(names, sizes, want, strict=True):
        assert {r.source_size for r in by[n]} == {size}
        assert by[n][0].target == pytest.approx(target, abs=1e-6)
        assert abs(sum(r.taken for r in by[n]) - target) <= 0.5
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_plan(docs.repartition(3)).collect()))
    places = [r.position for r in rows if r.position is not None]
    assert all(0 <= p <= 1 for p in places)


def test_mixed_documents_are_whole_and_in_order(make_docs, no_docs):
    docs = make_docs([f"w{i} " * (1 + i % 9) for i in range(120)], source=lambda i: f"s{i % 3}")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    plan = {r.doc_id: r for r in mixing.mix_plan(docs, cut=False).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == {i: r.taken // r.size for i, r in plan.items() if r.taken}
    assert mixing.mix_plan(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def test_position_inverts_the_schedule(spark):
    knots = ((0.0, 1.0), (0.5, 3.0), (1.0, 0.0))
    from pyspark.sql import functions as F

    rows = spark.range(0, 101).select((F.col("id") / 100).alias("q")).select("q", mixing.position_of(F.col("q"), mixing._segments(knots)).alias("t")).collect()

    def integral(t):
        return sum((min(t, b[0]) - a[0]) * (a[1] + a[1] + (b[1] - a[1]) * (min(t, b[0]) - a[0]) / (b[0] - a[0])) / 2 for a, b in zip(knots, knots[1:]) if t > a[0])

    for r in rows:
        assert integral(r.t) / integral(1.0) == pytest.approx(r.q, abs=1e-9)


def test_shards_are_even_and_slots_gapless(make_docs, no_docs):
    texts = ["y" * (i * 37 % 900) for i in range(900)] + [None, "é"]
    rows = sharding.assign_shards(make_docs(texts, extra=True), shards=8, slots=256).collect()
    places, load = defaultdict(list), Counter()
    for r in rows:
        places[r.shard].append(r.slot)
        load[r.shard] += r.size
        assert r.size == len((texts[r.doc_id] or "").encode()) + 16 and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) < 1.03 * sum(load.values()) / 8
    assert sharding.assign_shards(no_docs, shards=4, slots=16).count() == 0


def test_rows_follow_the_stored_map(spark, tmp_path):
    """Every column of every row against the map as stored: shard of its slot, checksum, size and a gapless place."""
    rows = [(i, "z" * (i * 53 % 400), "u") for i in range(500)] + [(7, "same", "u"), (7, "same", "v"), (7, "other", "w"), (None, "same", "x"), (None, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    path = str(tmp_path / "map")
    got = sharding.assign_shards(docs, shards=6, slots=128, map_path=path).collect()
    stored = {r.vslot: r.shard for r in spark.read.parquet(f"{path}/version={got[0].map_version}").collect()}
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert all(r.shard == stored[r.vslot] for r in got)
    slot_of = defaultdict(set)
    for r in got:
        slot_of[r.doc_id, r.text_crc32].add(r.vslot)
    assert all(len(v) == 1 for v in slot_of.values())
    for s in range(6):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_a_later_run_edits_the_stored_map(spark, make_docs, tmp_path):
    path, texts = str(tmp_path / "map"), ["y" * (i * 37 % 900) for i in range(3000)]
    first = {r.doc_id: r.shard for r in sharding.assign_shards(make_docs(texts[:2500]), 8, 512, path).collect()}
    versions = sharding.stored_versions(spark, path)
    again = {r.doc_id: r.shard for r in sharding.assign_shards(make_docs(texts[:2500]), 8, 512, path).collect()}
    assert again == first and sharding.stored_versions(spark, path) == versions
    more = sharding.assign_shards(make_docs(texts), 8, 512, path).collect()
    load = Counter()
    for r in more:
        load[r.shard] += r.size
    moved = sum(first.get(r.doc_id, r.shard) != r.shard for r in more)
    assert 0 < moved < 0.15 * len(first) and max(load.values()) < 1.01 * sum(load.values()) / 8
    assert sharding.stored_versions(spark, path) == [*versions, versions[-1] + 1]
    before = {r.doc_id: r.shard for r in more}
    wider = {r.doc_id: r.shard for r in sharding.assign_shards(make_docs(texts), 9, 512, path).collect()}
    assert sum(wider[d] != before[d] for d in wider) < 0.2 * len(wider) and 8 in wider.values()
    with pytest.raises(ValueError, match="only added"):
        sharding.assign_shards(make_docs(texts[:9]), 4, 512, path)


def test_mix_with_ties_and_without_ids(spark):
    rows = [(None, "a b", "s"), (None, "a b", "s"), (None, "c d e", "s"), (4, "a", "t"), (4, "a", "t"), (4, "b c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as position", "2 as tie")
    plan = [sorted(map(str, mixing.mix_plan(docs.repartition(n)).collect())) for n in (1, 3)]
    assert plan[0] == plan[1] and len(plan[0]) == 6
    ranges = {r.key[:3] for r in docs.select(*mixing._key("doc_id", "text")).collect()}
    assert len(ranges) >= 3


def test_slot_map_versions(spark, tmp_path):
    sums = [(i * 7919) % 1000 + 1 for i in range(512)]
    first = sharding.SlotMap.dealt(512, 10).rebalance(sums)
    assert first.version == 1 and first.rebalance(sums) is first
    grown = first.grow(sums)
    assert grown.version == 2 and all(b in (a, 10) for a, b in zip(first.shard_of, grown.shard_of, strict=True))
    assert max(grown.loads(sums)) <= max(first.loads(sums)) and grown.loads(sums)[10] > 0.8 * sum(sums) / 11
    skewed = sharding.SlotMap(4, 10, tuple(0 if i % 2 else i % 10 for i in range(512)))
    even = skewed.rebalance(sums)
    assert even.version == 5 and max(even.loads(sums)) - min(even.loads(sums)) <= 0.03 * sum(sums) / 10
    path = str(tmp_path / "map")
    for m in (first, grown):
        sharding.store_slot_map(spark, m, path)
    assert sharding.load_slot_map(spark, path) == grown and sharding.load_slot_map(spark, path, 1) == first
