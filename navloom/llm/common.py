"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space and words as all operators here read them (ASCII classes only).
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch.
BATCH_ROWS = 1000
#: As many keys of a join get salts; their table is broadcast.
HEAVY_KEYS = 1000
#: Rows of a heavy key that share a salt.
ROWS_PER_SALT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Only a local session without one gets its own; on a cluster this raises."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="navloom-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


class _Written(threading.local):
    """Tables written by ``cut_lineage`` that nothing has dropped yet, in the order of writing; each thread has its own list."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_written = _Written()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from the written copy."""
    path = shared_path(df.sparkSession, "cut")
    out = written_at(df, path)
    _written.paths.append(path)
    return out


def mark_tables() -> int:
    """Where to drop tables from later."""
    return len(_written.paths)


def drop_tables(spark: SparkSession, mark: int, keep: int = 0) -> None:
    """Delete what ``cut_lineage`` wrote since ``mark``, but for the ``keep`` last ones; nothing may read the others any more.

    The collection of garbage lets Spark's cleaner remove their shuffle files as well.
    """
    ends = len(_written.paths) - keep
    paths, _written.paths[mark:ends] = _written.paths[mark:ends], []
    for path in paths:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Rows of whole texts reach Python ``BATCH_ROWS`` at a time, unless the session has a number of its own.

    Spark's default of 10,000 rows makes batches of many MB, on both sides, where texts are long.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for a table that outlives one query plan."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder. What depends on how the input was split, as row numbers do, is fixed by that one write."""
    return written_at(df, shared_path(df.sparkSession, name))


def written_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def heavy_keys(df: DataFrame, keys: Sequence[str], count: Column | None = None) -> list[Row]:
    """``keys`` and ``salts`` of the keys with more than ``ROWS_PER_SALT`` rows: a list of the ``HEAVY_KEYS`` heaviest at most.

    No other key holds more than one row in ``HEAVY_KEYS``. ``count`` names the number of rows where ``df`` already
    has one row for each key. ``df`` is read for it, so it should be a written table.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("salts")) if count is None else df.select(*keys, count.alias("salts"))
    top = counted.filter(F.col("salts") > ROWS_PER_SALT).orderBy(F.desc("salts"), *keys).limit(HEAVY_KEYS)
    return top.withColumn("salts", F.ceil(F.col("salts") / ROWS_PER_SALT).cast("int")).collect()


def salted_join(big: DataFrame, side: DataFrame, keys: Sequence[str], spread: Sequence[str], heavy: list[Row] | None = None) -> DataFrame:
    """Inner join of ``big`` and ``side`` on ``keys`` in which no heavy key of ``big`` meets in one task.

    Rows of a heavy key are dealt over its salts by the columns ``spread``, and the rows of ``side`` are repeated for
    each salt. Without heavy keys it is a plain join.
    """
    heavy = heavy_keys(big, keys) if heavy is None else heavy
    if not heavy:
        return big.join(side, [*keys])
    salt, salts = fresh_names([*big.columns, *side.columns], "salt", "salts")
    schema = T.StructType([*(T.StructField(k, big.schema[k].dataType) for k in keys), T.StructField(salts, T.IntegerType())])
    table = F.broadcast(big.sparkSession.createDataFrame([tuple(r) for r in heavy], schema))
    number = F.coalesce(F.col(salts), F.lit(1))
    left = big.join(table, [*keys], "left").withColumn(salt, F.pmod(F.xxhash64(*spread), number).cast("int")).drop(salts)
    right = side.join(table, [*keys], "left").withColumn(salt, F.explode(F.sequence(F.lit(0), number - 1))).drop(salts)
    return left.join(right, [*keys, salt]).drop(salt)


def fresh_names(taken_names: Sequence[str], *names: str) -> list[str]:
    """Names starting with ``names`` that are none of ``taken_names``, whatever their case."""
    taken, out = {c.lower() for c in taken_names}, []
    for name in names:
        n = f"__{name}"
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names starting with ``names`` that clash with no column of ``df``, whatever its case."""
    return fresh_names(df.columns, *names)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
