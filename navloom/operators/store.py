"""Stored result sets by scope: replaced as wholes, read while others write, recomputed only where their inputs changed.

A run writes its rows under its own number, then the scopes it covers with a digest of their inputs. That second write
is the commit: readers look at finished runs only, and take each scope's rows from the newest run that covers it. So a run that
fails is never seen, a set may be replaced by an empty one, and a reader of older runs is not disturbed. What a table
holds is told by a digest that does not depend on the order or the partitions of its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _plain(field: T.StructField) -> Column:
    """A cell as text that no other cell of its column shares: null apart from empty, lengths before values."""
    c = F.col(f"`{field.name}`")
    text = F.hex(c) if isinstance(field.dataType, T.BinaryType) else c.cast("string") if isinstance(field.dataType, T.AtomicType) else F.to_json(F.struct(c), {"ignoreNullFields": "false"})
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.char_length(text).cast("string"), F.lit(":"), text))


def fingerprint(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., rows, digest): one digest of all rows, or one for each value of ``by``. Equal for the same rows in any order, each as often.

    Rows are hashed where they are; only sums of four parts of the hashes move, so no row is collected or sorted.
    """
    names = [f for f in sorted(df.schema.fields, key=lambda f: f.name) if f.name not in by]
    row = F.sha2(F.concat(F.lit(""), *(_plain(f) for f in names)), 256)
    # Parts are added in halves as whole numbers of 32 bits, which is cheap, and put together at the end.
    half = [F.sum(F.conv(F.substring("__row", 8 * i + 1, 8), 16, 10).cast("long")).alias(f"__{i}") for i in range(8)]
    whole = [(F.col(f"__{2 * i}").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col(f"__{2 * i + 1}").cast("decimal(20,0)")).cast("decimal(30,0)") for i in range(4)]
    summed = df.select(*by, row.alias("__row")).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *half)
    head = ",".join(f.name for f in names)
    digest = F.sha2(F.concat_ws("|", F.lit(head), F.col("rows").cast("string"), *(F.coalesce(c, F.lit(0)).cast("string") for c in whole)), 256)
    return summed.select(*by, "rows", digest.alias("digest"))


class Refreshed(NamedTuple):
    run: int | None
    changed: int
    gone: int
    kept: int


class Store:
    """Sets of rows under ``path``, told apart by the columns ``scope``; ``schema`` is that of the rows, those columns included."""

    def __init__(self, spark: SparkSession, path: str, scope: Sequence[str], schema: T.StructType) -> None:
        self.spark, self.path, self.scope, self.schema = spark, path, list(scope), schema
        self.scopes_schema = T.StructType([*(schema[c] for c in scope), T.StructField("inputs", T.StringType())])

    def _runs(self, part: str, finished: bool) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        folders = [s.getPath() for s in fs.listStatus(root)]
        named = [p for p in folders if p.getName().startswith("run=")]
        done = [p for p in named if not finished or fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()[4:]) for p in done)

    def _read(self, part: str, runs: list[int], schema: T.StructType) -> DataFrame:
        whole = T.StructType([*schema, T.StructField("run", T.IntegerType())])
        if not runs:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).option("basePath", f"{self.path}/{part}").parquet(*(f"{self.path}/{part}/run={n}" for n in runs))

    def newest(self) -> DataFrame:
        """(scope..., inputs, run) of each scope's newest finished run."""
        scopes = self._read("scopes", self._runs("scopes", True), self.scopes_schema)
        return scopes.groupBy(*self.scope).agg(F.max(F.struct("run", "inputs")).alias("x")).select(*self.scope, "x.inputs", "x.run")

    def current(self) -> DataFrame:
        """The rows of each scope as its newest finished run left them. Those of the newest run are all current, so they meet no scopes."""
        runs = self._runs("scopes", True)
        last = self._read("rows", runs[-1:], self.schema).select(*self.schema.names)
        if len(runs) < 2:
            return last
        older = self._read("rows", runs[:-1], self.schema)
        return older.join(self.newest().select(*self.scope, "run"), [*self.scope, "run"], "left_semi").select(*self.schema.names).unionByName(last)

    def save(self, rows: DataFrame, scopes: DataFrame) -> int:
        """Store ``rows`` as the sets of ``scopes`` (with ``inputs`` or without); scopes without rows are stored as empty. Rows of other scopes are an error."""
        run = max([0, *self._runs("rows", False), *self._runs("scopes", False)]) + 1
        covered = (scopes if "inputs" in scopes.columns else scopes.withColumn("inputs", F.lit(None).cast("string"))).select(*self.scope, "inputs").dropDuplicates(self.scope).persist()
        try:
            # Computed figures share only their first bits, which this codec finds.
            rows.select(*self.schema.names).write.option("compression", "zstd").parquet(f"{self.path}/rows/run={run}")
            # Rows are checked by the scopes that were written, each once, so that none moves to meet the scopes covered.
            found = self._read("rows", [run], self.schema).select(*self.scope).distinct()
            if not found.join(covered, self.scope, "left_anti").isEmpty():
                raise ValueError("a row of a scope that the run does not cover")
            covered.write.parquet(f"{self.path}/scopes/run={run}")
        finally:
            covered.unpersist()
        return run

    def refresh(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> Refreshed:
        """Bring the store to the scopes ``wanted`` (scope..., inputs): compute and store those whose inputs are new or differ, and empty those no longer wanted.

        ``compute`` gets the changed scopes and returns their rows. Nothing is written when nothing changed.
        """
        stored = self.newest().select(*self.scope, F.col("inputs").alias("had"), F.lit(True).alias("stored"))
        both = wanted.select(*self.scope, "inputs", F.lit(True).alias("asked")).join(stored, self.scope, "full")
        changed = F.col("asked").isNotNull() & (F.col("stored").isNull() | ~F.col("inputs").eqNullSafe(F.col("had")))
        gone = F.col("asked").isNull() & F.col("had").isNotNull()
        # What to do is found once, and read by the counts, the rows and the scopes.
        both = both.persist()
        counts = both.agg(F.count_if(changed).alias("changed"), F.count_if(gone).alias("gone"), F.count_if(F.col("asked").isNotNull() & ~changed).alias("kept")).first()
        run = None
        if counts["changed"] or counts["gone"]:
            todo = both.filter(changed).select(*self.scope, "inputs")
            # An emptied scope has no inputs, which is how it is known to be empty already.
            run = self.save(compute(todo.select(*self.scope)), todo.unionByName(both.filter(gone).select(*self.scope, F.lit(None).cast("string").alias("inputs"))))
        both.unpersist()
        return Refreshed(run, counts["changed"], counts["gone"], counts["kept"])


def load_files(store: Store, files: DataFrame, reader: str, parse: Callable[[DataFrame], DataFrame]) -> Refreshed:
    """Load files (file_id, content) into a store with scope file_id, each content once per version of its reader.

    A file already loaded is skipped, also after a restart, since the store itself says what it holds; a newer reader loads it again in its
    place. Files that are not among ``files`` stay as they are.
    """
    digest = F.sha2(F.concat(F.lit(f"{reader}|"), F.sha2(F.col("content").cast("binary"), 256)), 256)
    wanted = files.select("file_id", digest.alias("inputs"))
    others = store.newest().filter("inputs is not null").join(files.select("file_id"), "file_id", "left_anti").select("file_id", "inputs")
    return store.refresh(wanted.unionByName(others), lambda scopes: parse(files.join(scopes, "file_id", "left_semi")))
