from __future__ import annotations

import os
from collections import Counter

import pytest

import corpus_pipeline
from navloom.llm import bpe, exact_dedup, mixing, ngram_join, quality

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables")
def test_stages_on_the_smallest_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    columns, ids = docs.columns, Counter(r.doc_id for r in docs.select("doc_id").collect())
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(i))
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        if i == 0:
            want = {r.doc_id for r in quality.score_documents(docs, labels).collect() if r.predicted}
        elif i == 1:
            want = {r.doc_id for r in exact_dedup.duplicate_classes(docs).collect() if r.kept}
        elif i == 2:
            want = {r.component_id for r in ngram_join.near_duplicate_classes(docs, 5, 80).collect()}
        elif i == 3:
            want = {r.doc_id for r in mixing.mix_plan(docs, cut=False).collect() if r.taken}
        else:
            want = {r.doc_id for r in docs.collect()}
        got = Counter(r.doc_id for r in out.select("doc_id").collect())
        assert set(got) == want and set(got) <= set(ids)
        if i < 4:
            assert out.columns == columns
        seen.append(sum(got.values()))
        docs = out
    assert seen[0] <= sum(ids.values()) and seen[2] <= seen[1] <= seen[0] and seen[3] == seen[4]
    assert bpe.encode_documents(spark.read.parquet(str(tmp_path / "3")), __import__("public_tokenizers").path("word_bpe_49k.json")).count() == seen[4]


def stages(spark, tmp_path, rows, labels=()):
    """The result of each stage on a table of its own, with columns that clash with the operators' own names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, `row` string, digest string, size long"
    d = str(tmp_path / "in")
    spark.createDataFrame([(i, t, "en", s, len(t or ""), "r", "d", 1) for i, t, s in rows], schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        out.append(docs)
    return d, out


def test_odd_rows_against_brute_force(spark, tmp_path):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:59], "other"])
    rows = [(1, " ".join(base), "a"), (2, near, "a"), (3, "one  two", "b"), (4, "one two", "b"), (4, "one two", "b"), (None, "x y z " * 5, None), (None, None, None), (7, "", "b"), (8, "lone words here", "c")]
    d, out = stages(spark, tmp_path, rows)
    ids = [Counter(r.doc_id for r in o.select("doc_id").collect()) for o in out]
    # No labels: all stay. Then one of equal texts, and one of the similar pair.
    assert ids[0] == Counter(r[0] for r in rows)
    assert ids[1] == Counter([1, 2, 3, None, 7, 8]) and ids[2] == Counter([1, 3, None, 7, 8])
    # Sources a, b, c and none weigh 5, 2, 1, 5 of 150 % of 60 + 2 + 3 + 15 words; a stops at 120, b at 4, c at 6, none at 30.
    assert set(ids[3]) <= {1, 3, None, 8} and 1 <= ids[3][1] <= 2
    assert all(o.columns == out[0].columns for o in out[:4]) and ids[4] == ids[3]
    from tokenizers import Tokenizer

    library, text = Tokenizer.from_file(__import__("public_tokenizers").path("word_bpe_49k.json")), {r[0]: r[1] for r in rows if r[1]}
    for r in out[4].collect():
        want = library.encode(text[r.doc_id] if r.doc_id != 4 else "one two", add_special_tokens=False)
        assert r.n_tokens == len(want.ids) or r.doc_id == 3
    whole = corpus_pipeline.run(spark, d)
    assert Counter(r.doc_id for r in whole.collect()) == ids[4]


def test_empty_tables(spark, tmp_path):
    _, out = stages(spark, tmp_path, [])
    assert [o.count() for o in out] == [0] * 5
