from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from navloom.llm import winnow

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_in(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(texts, items, window):
    wanted = {}
    for item, text in items:
        w = words_in(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            wanted.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for text in texts:
        w, hit, found = words_in(text), set(), set()
        for size in {len(x) for x in wanted}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in wanted:
                    hit.update(range(i, i + size))
                    found |= wanted[tuple(w[i : i + size])]
        out.append((len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit)))
    return out


def case(words):
    r = random.Random(8)
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, say(r.randint(10, 60))) for i in range(30)]
    items += [(100, items[0][1]), (0, items[1][1]), (None, items[2][1]), (101, "Größe, des; Hauses"), (102, "a b"), (103, "zz"), (104, None), (105, " - "), (106, "le " * 40), (107, "a b")]
    texts = [say(r.randint(1, 120)) for _ in range(30)]
    for i in range(30):  # passages of 9 to all words, with other marks and cases around them
        w = items[i][1].split()
        n = r.choice([9, 10, 11, len(w)])
        at = r.randint(0, max(0, len(w) - n))
        texts.append(say(20) + ". " + ", ".join(w[at : at + n]).upper() + "! " + say(20))
    texts += [items[3][1] + " " + items[3][1], items[4][1] + items[5][1], "GRÖSSE größe DES Hauses zz a b a b", "zz", "zz " * 2000, "le " * 9, "le " * 25, None, "", " .,- ", "x" * 50_000]
    return [*texts, texts[31]], items


@pytest.mark.parametrize("window", [10, 4])
def test_matches_plain_search(spark, make_docs, words, window):
    texts, items = case(words)
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit("x"))
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in winnow.contamination(make_docs(texts, extra=True), table, window).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, items, window)


def test_hot_windows_and_full_bitmap(spark, make_docs, words):
    """A passage that most documents share, and a bitmap so small that nearly every window is joined."""
    r = random.Random(9)
    shared = " ".join(r.choice(words) for _ in range(30))
    items = [(i, shared if i % 2 else " ".join(r.choice(words) for _ in range(40))) for i in range(40)]
    texts = [shared + " " + r.choice(words) for _ in range(1500)] + [" ".join(r.choice(words) for _ in range(50)) for _ in range(50)]
    got = {x.doc_id: (x.n_words, x.n_hit, x["items"], x.contaminated) for x in winnow.contamination(make_docs(texts), spark.createDataFrame(items, "item_id long, text string"), bits=1 << 10).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, items, 10)


def test_empty_tables(spark, make_docs, no_docs):
    items, none = spark.createDataFrame([(1, "a b c")], "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert winnow.contamination(no_docs, items).collect() == []
    assert [(x.n_words, x.n_hit, x.n_items, x.contaminated) for x in winnow.contamination(make_docs(["a b c"]), none).collect()] == [(3, 0, 0, False)]


def test_every_window_keeps_a_fingerprint_of_its_own_words():
    import numpy as np

    r = np.random.default_rng(1)
    text = r.integers(0, 2**63, 300).astype(np.uint64)
    whole = winnow.fingerprints(text, 10, 10)
    assert all(winnow.fingerprints(text[i : i + 10], 10, 10)[0] == whole[i] for i in range(291))
    assert len(set(whole.tolist())) < 300 / 2.5
