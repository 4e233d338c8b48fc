"""Row numbers stay the same when the input's splits change between jobs."""

from __future__ import annotations

import random

import pytest

from navloom.llm import ngram_join


@pytest.fixture
def shifting(spark, monkeypatch, tmp_path):
    """Twelve files of different sizes, read in other splits after every checkpoint."""
    r = random.Random(8)
    texts = [" ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randint(0, 99)) for _ in range(30)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " z") for i, t in enumerate(texts)]
    r.shuffle(rows)
    path, at = str(tmp_path / "docs"), 0
    for n in (1, 3, 4, 6, 8, 9, 11, 12, 14, 15, 18, 19):
        spark.createDataFrame(rows[at : at + n], "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
        at += n
    sizes, cut, conf = ["1k", "128m"], ngram_join.cut_lineage, "spark.sql.files.maxPartitionBytes"

    def cut_and_shift(df):
        out = cut(df)
        sizes.append(sizes.pop(0))
        spark.conf.set(conf, sizes[0])
        return out

    monkeypatch.setattr(ngram_join, "cut_lineage", cut_and_shift)
    yield spark.read.parquet(path)
    spark.conf.unset(conf)


def test_no_link_is_lost(shifting):
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicate_classes(shifting).collect()}
    assert got == {i: i % 100 for i in (*range(60), *range(100, 160))}


def test_one_of_each_stays(shifting):
    assert sorted(r.doc_id for r in ngram_join.one_of_each_class(shifting).collect()) == list(range(60))


def test_numbers_don_t_depend_on_the_splits(spark, shifting):
    rows, seen = ngram_join._numbered(shifting, "doc_id", "text"), []
    for size in ("1k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        seen.append({r.doc_id: r.row for r in rows.select("doc_id", "row").collect()})
    assert seen[0] == seen[1]
