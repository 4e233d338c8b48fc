"""Exact dedup by two Bloom passes: only rows whose hash may repeat are shuffled.

Pass one hashes every row's text digest to a few cells and notes the cells that two or more rows hit, as
bitmaps. Pass two tests each row's cells against the bitmaps: a row with a cell of its own cannot have a
copy, so it passes straight through; the others (all copies, and few more) are grouped by digest. What pass one
itself moves are counts of cells, two numbers each. A digest that many rows share is dealt over several tasks.

Defined cases
    * null text counts as empty; texts are equal when identical after each run of ASCII white space became one space;
    * of equal texts the smallest ``doc_id`` stays, a null id only if there is no other;
    * rows repeated with the same id and text: exactly one of them is kept;
    * empty table: empty result; other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navloom.llm.bloom import MAX_BITS, bitmaps, filter_bits, with_maybe
from navloom.llm.common import SPACE_RE, cut_lineage, fresh, heavy_keys, salted_join, text_or_empty, written_once


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE_RE, " ")


def text_digest(text: str | Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, hashes: int = 2, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``max_bits`` bounds the broadcast (64 MB by default, enough for 33 million rows at 16 bits each). With more
    rows the filter lets a larger share of the digests through to the shuffle, and the result stays the same.
    """
    narrow = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), text_digest(text_col).alias("digest"), F.monotonically_increasing_id().alias("row")))
    bits = filter_bits(narrow.count(), bits_per_row, max_bits)
    flagged = with_maybe(narrow, "digest", bitmaps(narrow, "digest", bits, hashes, at_least=2), bits, "maybe", hashes)
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    alone = flagged.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    rest = flagged.filter("maybe")
    first = rest.groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"),
        F.count(F.lit(1)).alias("group_size"),
    )
    first = cut_lineage(first)
    heavy = heavy_keys(first, ["digest"], F.col("group_size"))
    together = salted_join(rest, first, ["digest"], ["row"], heavy).select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), sha)
    return alone.unionByName(together)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, hashes: int = 2, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Only rows that may have a copy are shuffled."""
    digest, row, maybe, first = fresh(docs, "digest", "row", "maybe", "first")
    marked = docs.withColumn(digest, text_digest(text_col))
    digests = cut_lineage(marked.select(F.col(digest).alias("digest")))
    bits = filter_bits(digests.count(), bits_per_row, max_bits)
    flagged = with_maybe(marked, digest, bitmaps(digests, "digest", bits, hashes, at_least=2), bits, maybe, hashes)
    # The rows are joined back by number, so both sides must read the same numbers.
    rest = written_once(flagged.filter(F.col(maybe)).withColumn(row, F.monotonically_increasing_id()), "numbered")
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    stays = rest.groupBy(digest).agg(F.min(key).alias(first)).select(digest, F.col(first)["row"].alias(row))
    kept = rest.join(stays, [digest, row], "left_semi")
    return flagged.filter(~F.col(maybe)).select(*docs.columns).unionByName(kept.select(*docs.columns))
