from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from navloom.operators.store import Store, fingerprint, load_files


def rows(spark, data):
    return spark.createDataFrame(data, "user_id long, issuer string, amount double")


def test_fingerprints_tell_content_from_order(spark):
    df = rows(spark, [(1, "a", 1.5), (1, "b", None), (2, "", 2.0), (2, "", 2.0), (3, None, 0.1)]).withColumn("more", F.array("issuer")).withColumn("raw", F.encode("issuer", "utf-8"))
    digest = lambda x: fingerprint(x).first()["digest"]
    whole = digest(df)
    assert digest(df.repartition(7)) == digest(df.orderBy(F.desc("amount"))) == digest(df.select(*reversed(df.columns))) == whole
    changed = [df.withColumn("amount", F.when(F.col("user_id") == 3, 0.2).otherwise(F.col("amount"))), df.dropDuplicates(["user_id", "issuer", "amount"]), df.fillna({"issuer": ""}), df.withColumnRenamed("amount", "sum"), df.limit(4), df.filter("false")]
    assert len({whole, *map(digest, changed)}) == 7
    # Values don't run over from one cell into the next.
    pair = spark.createDataFrame([("ab", "c")], "x string, y string"), spark.createDataFrame([("a", "bc")], "x string, y string")
    assert digest(pair[0]) != digest(pair[1])
    by_user = {r.user_id: (r["rows"], r.digest) for r in fingerprint(df, ["user_id"]).collect()}
    again = {r.user_id: (r["rows"], r.digest) for r in fingerprint(changed[0], ["user_id"]).collect()}
    assert [k for k in by_user if by_user[k] != again[k]] == [3] and by_user[2][0] == 2


def test_sets_are_replaced_as_wholes_and_failing_runs_are_not_seen(spark, tmp_path):
    first = rows(spark, [(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)])
    store = Store(spark, str(tmp_path / "s"), ["user_id"], first.schema)
    read = lambda: sorted(tuple(r) for r in store.current().collect())
    assert read() == []
    assert store.save(first, first.select("user_id")) == 1
    before = store.current()
    assert store.save(rows(spark, [(1, "c", 9.0)]), rows(spark, [(1, "", 0.0), (3, "", 0.0)]).select("user_id")) == 2
    assert read() == [(1, "c", 9.0), (2, "a", 3.0)]
    assert sorted(tuple(r) for r in before.collect()) == [(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)]
    store.save(first.filter("false"), first.filter("user_id = 2").select("user_id"))
    assert read() == [(1, "c", 9.0)]
    bad = first.withColumn("amount", F.when(F.col("user_id") == 2, F.raise_error(F.lit("no")).cast("double")).otherwise(F.col("amount")))
    with pytest.raises(Exception, match="no"):
        store.save(bad, first.select("user_id"))
    assert read() == [(1, "c", 9.0)]
    with pytest.raises(Exception, match="does not cover"):
        store.save(first, first.filter("user_id = 1").select("user_id"))
    assert read() == [(1, "c", 9.0)]
    # Rows of a run that stopped before its scopes were written.
    rows(spark, [(1, "lost", 0.0)]).write.parquet(str(tmp_path / "s" / "rows" / "run=9"))
    assert read() == [(1, "c", 9.0)]
    assert store.save(first, first.select("user_id")) == 10
    assert len(read()) == 3


def test_refresh_computes_changed_scopes_only(spark, tmp_path):
    schema = rows(spark, []).schema
    store, asked = Store(spark, str(tmp_path / "s"), ["user_id"], schema), []

    def step(data):
        table = rows(spark, data)
        wanted = fingerprint(table, ["user_id"]).select("user_id", F.col("digest").alias("inputs"))

        def compute(scopes):
            asked.append(sorted(r.user_id for r in scopes.collect()))
            return table.join(scopes, "user_id", "left_semi").withColumn("amount", F.col("amount") * 2)

        out = store.refresh(wanted, compute)
        assert sorted(tuple(r) for r in store.current().collect()) == sorted((u, i, a * 2) for u, i, a in data)
        return out

    data = [(1, "a", 1.0), (2, "a", 2.0), (3, "a", 3.0)]
    assert step(data) == (1, 3, 0, 0)
    assert step(data[::-1]) == (None, 0, 0, 3)
    assert step([(1, "a", 1.0), (2, "a", 5.0), (4, "z", 1.0)]) == (2, 2, 1, 1)
    assert step([(1, "a", 1.0), (2, "a", 5.0), (4, "z", 1.0)]) == (None, 0, 0, 3)
    assert step(data) == (3, 2, 1, 1)
    assert asked == [[1, 2, 3], [2, 4], [2, 3]]


def test_files_are_loaded_once_per_reader(spark, tmp_path):
    files = lambda *x: spark.createDataFrame(x, "file_id string, content string")
    made = files(("a", "1,2"), ("b", "3"))
    parse = lambda f: f.select("file_id", F.explode(F.split("content", ",")).alias("value"))
    path = str(tmp_path / "s")
    store = Store(spark, path, ["file_id"], parse(made).schema)
    assert load_files(store, made, "1", parse) == (1, 2, 0, 0)
    store = Store(spark, path, ["file_id"], parse(made).schema)  # as after a restart
    assert load_files(store, made, "1", parse) == (None, 0, 0, 2)
    assert load_files(store, files(("b", "3"), ("c", "4,5")), "1", parse) == (2, 1, 0, 2)
    assert load_files(store, files(("a", "1,2")), "2", lambda f: parse(f).withColumn("value", F.concat(F.lit("v"), "value"))) == (3, 1, 0, 2)
    assert sorted(tuple(r) for r in store.current().collect()) == [("a", "v1"), ("a", "v2"), ("b", "3"), ("c", "4"), ("c", "5")]
