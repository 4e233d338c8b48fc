from __future__ import annotations

import hashlib
import math
import random
import zlib

import pytest

from navloom.llm import prefix_trie

ROWS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, borrow=True):
    """The nodes by walking every conversation down a dictionary."""
    turns = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns.setdefault(conv, []).append((role or "", text or ""))
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - int(math.fmod(c, 5)), [])[:h] + turns[c][h:] if borrow else turns[c]
    nodes = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        parents = {k[:-1] for k in below if k}
        ends = ",".join(str(c) for c in sorted(c for c in members if tuple(built[c]) == key))
        out.append((
            min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), sum(len(k) == len(key) + 1 for k in below),
            sum(k not in parents for k in below), sum((len(nodes[k]) - 1) * len(k[-1][1].encode()) for k in below if k), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def conversations(seed, n, spread, same):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        c = c if r.random() < 0.9 else c + 1000
        turns = [(r.choice("ua"), "".join(r.choice("xyé") for _ in range(r.choice([0, 1, 3])))) for _ in range(r.randint(1, spread))]
        if r.random() < same:
            turns = [("u", "x"), ("a", "y")] * r.randint(1, spread)
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    return rows


def got(spark, rows, borrow=True, parts=None):
    df = spark.createDataFrame(rows, ROWS)
    if parts:
        df = df.repartition(parts)
    return sorted((tuple(x) for x in prefix_trie.conversation_trie(df.selectExpr("*", "1 as part", "2 as l"), borrow).select(*COLUMNS).collect()), key=str)


@pytest.fixture
def many_blocks(spark):
    """Small blocks, so that runs go over several of them."""
    names = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("seed", "n", "spread", "same", "borrow"), [(1, 60, 9, 0.1, True), (2, 80, 4, 0.5, False), (3, 90, 12, 0.3, True)])
def test_nodes_match_a_plain_trie(spark, many_blocks, seed, n, spread, same, borrow):
    rows = conversations(seed, n, spread, same)
    assert got(spark, rows, borrow) == plain(rows, borrow)


def test_odd_rows(spark):
    rows = [(3, None, "u", "a"), (3, 0, None, None), (3, 0, "u", "b"), (3, 0, "u", "b"), (None, 1, "u", "lost"), (0, 0, "u", None), (0, 1, "", ""), (-3, 0, "u", "b"), (-5, 0, "u", "b"), (7, 0, "u", "only"), (40, 2, "u", "x" * 30_000), (41, 1, "a", "y")]
    rows += [(90, i, "u", str(i % 2)) for i in range(3000)] + [(95, i, "u", str(i % 2)) for i in range(2990)]
    some = [r for r in rows if r[0] not in (90, 95)]
    assert got(spark, some) == plain(some)
    nodes = got(spark, rows, borrow=False)
    assert len(nodes) == len({x for c in {r[0] for r in rows if r[0] is not None} for x in _beginnings(rows, c)})
    assert got(spark, [(1, 0, "u", "a")], borrow=False) == plain([(1, 0, "u", "a")], borrow=False)


def _beginnings(rows, conv):
    turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
    return [hash(tuple(turns[:d])) for d in range(len(turns) + 1)]


def test_turnless_and_empty(spark):
    alone = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    rows = [(alone, 0, "u", "gone")]
    assert got(spark, rows) == plain(rows) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]
    assert got(spark, []) == []


def test_pointers():
    values = [3, 1, 1, 2, 0, 5, 5, 4]
    assert prefix_trie.next_smaller(values, [7, 6, 9, 3, 8, 2, 4, 1]) == ([1, 4, 4, 4, 8, 7, 7, 8], [7, 3, 3, 3, 1, 2, 4, 1])
    assert prefix_trie.last_smaller(values) == [-1, -1, -1, 2, -1, 4, 4, 4]
