"""Bloom filters as bounded bitmap tables: keys are looked up where the rows are, and the rest need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navloom.llm.common import fresh

#: Bits of one ``bitmap_construct_agg`` bitmap.
BITMAP_BITS = 32768
#: 64 MB of bitmaps at most; beyond this many keys more rows pass the filter, and results stay the same.
MAX_BITS = 1 << 29


def filter_bits(keys: int, bits_per_key: int = 16, max_bits: int = MAX_BITS) -> int:
    bits = BITMAP_BITS
    while bits < keys * bits_per_key and bits < max_bits:
        bits *= 2
    return bits


def cells(key: Column, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(hashes)]


def bitmaps(keys: DataFrame, key: str, bits: int, hashes: int = 2, at_least: int = 1) -> DataFrame:
    """(bucket, bitmap) of the cells that ``at_least`` rows hit: at most ``bits / 8`` bytes in all."""
    cell = F.explode(F.array_distinct(F.array(*cells(F.col(key), bits, hashes)))).alias("cell")
    hit = keys.select(cell).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least)
    return hit.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bitmap"))


def with_maybe(df: DataFrame, key: str, maps: DataFrame, bits: int, flag: str, hashes: int = 2) -> DataFrame:
    """Add ``flag``: all cells of the row's key are set. The bitmaps are bounded, so they are broadcast."""
    test, columns = F.lit(True), df.columns
    for i, cell in enumerate(cells(F.col(key), bits, hashes)):
        bucket, bitmap = fresh(df, f"bucket{i}", f"bitmap{i}")
        side = F.broadcast(maps.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap)))
        df = df.join(side, F.bitmap_bucket_number(cell) == F.col(bucket), "left")
        position = F.bitmap_bit_position(cell).cast("int")
        byte = F.conv(F.hex(F.substring(F.col(bitmap), F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        test &= F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), position % 8).cast("int")) != 0, F.lit(False))
    return df.select(*columns, test.alias(flag))


def marked(df: DataFrame, key: str, keys: DataFrame, flag: str) -> DataFrame:
    """Add ``flag``: the row's key is perhaps among ``keys`` (one column of the same name), and surely not if false."""
    bits = filter_bits(keys.count())
    return with_maybe(df, key, bitmaps(keys, key, bits), bits, flag)
