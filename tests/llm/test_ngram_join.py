from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from navloom.llm import common, ngram_join, shingles


def brute(texts, words, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({" ".join(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {" ".join(w)} if w else set())
    label = list(range(len(texts)))
    for _ in texts:
        before = list(label)
        for i in range(len(sets)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    return [(len(s), c) for s, c in zip(sets, label, strict=True)]


def corpus(words):
    r = random.Random(3)
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 90))) for _ in range(40)]
    base = [r.choice(words) for _ in range(80)]
    for _ in range(40):  # near copies of one text, some linked and some just not
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(" ".join(w))
    passage = " ".join(r.choice(words) for _ in range(50))
    texts += [passage + " " + " ".join(r.choice(words) for _ in range(40)) for _ in range(10)]
    return [*texts, texts[0], texts[0].upper(), "  " + texts[1] + "\n", None, "", " \t\n", "one", "One", "one two", "a b c", "word " * 3000, "x" * 50_000]


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_components_match_brute_force(make_docs, words, size, percent):
    texts = corpus(words)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicate_classes(make_docs(texts, extra=True), size, percent).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, size, percent)


def classes_by_lists(texts, words, percent):
    """Component of each text, comparing each with all that share a shingle, for groups too large for ``brute``."""
    number, sets = {}, []
    for t in texts:
        w = t.split()
        sets.append(np.array(sorted({number.setdefault(tuple(w[i : i + words]), len(number)) for i in range(len(w) - words + 1)})))
    holders = [[] for _ in number]
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    holders, size, label = [np.array(h) for h in holders], np.array([len(s) for s in sets]), np.arange(len(sets))
    for i, s in enumerate(sets):
        common = np.bincount(np.concatenate([holders[x] for x in s]), minlength=len(sets))
        met = np.unique(label[100 * common >= percent * (size[i] + size - common)])
        label[np.isin(label, met)] = met[0]
    return label.tolist()


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_large_group_of_near_copies(make_docs, words, size, percent, monkeypatch):
    """Two groups that differ in a few places, cut into several blocks, with links between the groups."""
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 20_000)
    monkeypatch.setattr(common, "ROWS_PER_SALT", 100)
    r = random.Random(11)
    base, texts = [r.choice(words) for _ in range(100)], []
    for i in range(2000):
        w = list(base)
        for at in range(i % 3 * 4):
            w[at * 12 + 5] = "other"
        for _ in range(r.randint(0, 4)):
            w[r.randrange(100)] = r.choice(words)
        texts.append(" ".join(w))
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicate_classes(make_docs(texts), size, percent).collect()}
    assert [got[i] for i in range(len(texts))] == classes_by_lists(texts, size, percent)


def test_repeated_rows_and_null_ids(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(None, text), (4, text), (4, text), (9, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in ngram_join.near_duplicate_classes(docs).collect())
    assert got == [(False, 4, 4), (False, 4, 4), (False, 9, 9), (True, 0, 4)]
    kept = ngram_join.one_of_each_class(docs).collect()
    assert sorted(r.doc_id for r in kept) == [4, 9]


def test_empty_table(no_docs):
    assert ngram_join.near_duplicate_classes(no_docs).count() == 0


def test_links_inside_a_cluster_connect_what_is_connected():
    r = np.random.default_rng(1)
    base = np.sort(r.choice(10**6, 200, replace=False))
    sets = [np.unique(np.concatenate([r.choice(base, 200 - k, replace=False), r.integers(10**6, 10**9, k)])) for k in r.integers(0, 25, 60)]
    near, lacking = np.zeros(60, bool), [np.setdiff1d(base, s) for s in sets]
    differing = [np.concatenate([no, np.setdiff1d(s, base)]) for no, s in zip(lacking, sets, strict=True)]
    want = {(i, j) for i in range(60) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))}
    got = list(ngram_join._joining_links(differing, np.array([len(x) for x in lacking]), np.array([len(s) for s in sets]), near, None, 90))
    assert {(max(p), min(p)) for p in got} <= want

    def classes(links):
        label = list(range(60))
        for _ in range(60):
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert classes(got) == classes(want)


def test_shingle_sets_of_slices():
    texts = ["A b c", None, "", "a B C d", "a"]
    whole = list(shingles.shingle_sets(pa.array(texts), 3))
    sliced = list(shingles.shingle_sets(pa.array(["zz", *texts]).slice(1), 3))
    assert [s.tolist() for s in whole] == [s.tolist() for s in sliced]
    assert [len(s) for s in whole] == [1, 0, 0, 2, 1]
    assert whole[0][0] in whole[3]
