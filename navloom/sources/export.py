"""Portable exports: rows as lines of JSON beside a header that says what they are, checked on the way back.

What costs much to fetch again outlives a store that way, also between versions. Coming back, rows only fill gaps: what
the table has already stays as it is.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from navloom.operators.store import fingerprint

FORMAT = 1


class ForeignExport(ValueError):
    """An export of another kind or format, or one whose rows are not those that were written."""


def save(df: DataFrame, path: str, kind: str) -> None:
    """Write ``df`` under ``path``: the rows, then the header, without which there is no export."""
    df.write.option("ignoreNullFields", "false").option("compression", "gzip").json(f"{path}/rows")
    spark = df.sparkSession
    told = fingerprint(spark.read.schema(df.schema).json(f"{path}/rows")).first()
    header = {"kind": kind, "format": FORMAT, "schema": df.schema.jsonValue(), "rows": told["rows"], "digest": told["digest"]}
    spark.createDataFrame([(json.dumps(header),)], "value string").coalesce(1).write.text(f"{path}/header")


def load(spark: SparkSession, path: str, kind: str, expected: T.StructType | None = None) -> DataFrame:
    """The rows of an export of this kind; anything else is refused, as are columns other than ``expected`` and rows that changed on the way."""
    header = json.loads(spark.read.text(f"{path}/header").first()["value"])
    if header.get("kind") != kind or header.get("format") != FORMAT:
        raise ForeignExport(f"an export of {header.get('kind')!r}, format {header.get('format')}; wanted {kind!r}, format {FORMAT}")
    schema = T.StructType.fromJson(header["schema"])
    if expected is not None and [(f.name, f.dataType) for f in expected] != [(f.name, f.dataType) for f in schema]:
        raise ForeignExport(f"its columns are {schema.simpleString()}, wanted {expected.simpleString()}")
    rows = spark.read.schema(schema).json(f"{path}/rows")
    told = fingerprint(rows).first()
    if (told["rows"], told["digest"]) != (header["rows"], header["digest"]):
        raise ForeignExport(f"{told['rows']} rows, of which some are not the {header['rows']} that were written")
    return rows


def restore(existing: DataFrame, path: str, kind: str, keys: Sequence[str]) -> DataFrame:
    """``existing`` and those rows of the export whose keys it lacks."""
    rows = load(existing.sparkSession, path, kind, existing.schema)
    return existing.unionByName(rows.join(existing.select(*keys).distinct(), [*keys], "left_anti"))
