"""Benchmark decontamination by winnowing.

Of the hashes of all runs of ``k`` words in a window of ``window`` words, the smallest is kept, the rightmost of equal
ones: a text's fingerprints. Two texts that share ``window`` words in a row keep the same hash there, so no shared window
is missed, and less than a third of all positions are looked at further. Benchmark fingerprints are put into a bitmap of
``BITMAP_BITS``, which every task holds. A document's fingerprint that hits it is extended: to each window of
words that kept it. Windows are joined by their words with those of the benchmark, so every hit is exact and no pair of
texts is compared. Items of fewer words than a window are windows themselves: every run of their number of words is
looked up the same way.

Equal windows of one document come in one row with all their places; a window that many documents share is dealt over
several tasks; and lists of items are made once per set of windows, not once per document.

Defined cases
    * null and empty texts, and texts without words, have no words and no hits; null items are part of nothing;
    * a null item_id is left out of the list of items, but its words count as hits;
    * repeated items, and item ids with several texts, count once; repeated documents, whatever their ids, one row each;
    * empty table of documents: empty result; without items no word is hit; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navloom.llm.common import cut_lineage, heavy_keys, salted_join, small_batches
from navloom.llm.shingles import mix, parts, rolled, words_and_starts

#: Bits of the bitmap of benchmark fingerprints: 16 MB. With more of them more windows are joined; results stay the same.
BITMAP_BITS = 1 << 27
#: Words of a fingerprint's run.
RUN = 5
#: Words are runs of ASCII letters and digits and of all bytes beyond ASCII.
_OTHER = np.ones(256, bool)
_OTHER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def kept(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes, the place of the smallest, the rightmost of equal ones."""
    runs = np.lib.stride_tricks.sliding_window_view(hashes, width)[:, ::-1]
    return np.arange(len(runs)) + width - 1 - np.argmin(runs, axis=1)


def fingerprints(hashes: np.ndarray, words: int, window: int) -> np.ndarray:
    """The fingerprint of each run of ``words`` words of a text, given its word hashes; ``words`` is ``window``, or fewer for short items."""
    if len(hashes) < words:
        return np.zeros(0, np.uint64)
    run = min(RUN, window) if words == window else words
    grams = rolled(hashes, run) ^ mix(np.array([words], np.uint64))
    return grams[kept(grams, words - run + 1)]


def _slots(prints: np.ndarray, bits: int) -> np.ndarray:
    return (prints & np.uint64(bits - 1)).astype(np.int64)


class _Words:
    """The words of one text, lower-cased, cut out when asked for."""

    def __init__(self, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> None:
        self.data, self.starts, self.ends = data, starts, starts + sizes

    def joined(self, at: int, count: int) -> bytes:
        return b" ".join([self.data[s:e] for s, e in zip(self.starts[at : at + count].tolist(), self.ends[at : at + count].tolist(), strict=True)])


def _texts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, _Words]]:
    for begin, part in parts(texts):
        hashes, starts, sizes, edges, letters, _ = words_and_starts(part, _OTHER)
        data = letters.tobytes().translate(_LOWER)
        for i in range(len(part)):
            at = slice(edges[i], edges[i + 1])
            yield begin + i, hashes[at], _Words(data, starts[at], sizes[at])


def benchmark_windows(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text", bits: int = BITMAP_BITS) -> DataFrame:
    """(words, item_id, slot, size) of each window of each item: its words in lower case, and where the bitmap holds its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, hashes, words in _texts(batch.column(1)):
                size = min(window, len(hashes))
                if size:
                    slots = _slots(fingerprints(hashes, size, window), bits)
                    ids = batch.column(0).take(pa.array(np.full(len(slots), i)))
                    yield pa.RecordBatch.from_arrays([pa.array([words.joined(w, size) for w in range(len(slots))], pa.binary()), ids, pa.array(slots), pa.array(np.full(len(slots), size, np.int32))], ["words", "item_id", "slot", "size"])

    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"words binary, item_id {kind}, slot long, size int").distinct()


def _bitmap(windows: DataFrame, bits: int) -> np.ndarray:
    """The slots of all fingerprints, from rows of 64 bits: ``bits / 8`` bytes on the driver, however many there are."""
    one = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    rows = windows.groupBy(F.floor(F.col("slot") / 64).alias("row")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("row").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)


def document_windows(docs: DataFrame, windows: DataFrame, window: int, bits: int = BITMAP_BITS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text), written once: row, doc_id, n_words, and the windows (words, size, places) whose fingerprint is in the bitmap."""
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(windows, bits))
    # How many words windows have: as many rows as ``window`` at most.
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("words", pa.binary()), ("size", pa.int32()), ("places", pa.list_(pa.int32()))]))
        for batch in batches:
            counts, found = [], []
            for _, hashes, words in _texts(batch.column(1)):
                places: dict[tuple[bytes, int], list[int]] = {}
                for size in sizes:
                    slots = _slots(fingerprints(hashes, size, window), bits)
                    for at in np.flatnonzero(bitmap.value[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).tolist():
                        places.setdefault((words.joined(at, size), size), []).append(at)
                counts.append(len(hashes))
                found.append([{"words": w, "size": n, "places": p} for (w, n), p in places.items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind)], ["doc_id", "n_words", "windows"])

    small_batches(docs.sparkSession)
    found = docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, windows array<struct<words:binary,size:int,places:array<int>>>")
    return cut_lineage(found.withColumn("row", F.monotonically_increasing_id()))


def _covered(spans: Column) -> Column:
    """How many words lie in spans (begin, end) sorted by begin."""

    def step(acc: Column, x: Column) -> Column:
        more = F.greatest(F.lit(0), x["end"] - F.greatest(acc["end"], x["begin"]))
        return F.struct(F.greatest(acc["end"], x["end"]).alias("end"), (acc["n"] + more).alias("n"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"].cast("long"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", bits: int = BITMAP_BITS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside a window of an item), n_items, items (their ids as strings, sorted), contaminated, spans.

    ``spans`` lists the windows hit as (begin, end) in words, sorted: what to cut out. ``window`` is 64 at most, ``bits`` a power of 2.
    """
    of_items = cut_lineage(benchmark_windows(items, window, item_col, item_text_col, bits))
    found = document_windows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), of_items, window, bits)
    candidates = found.select("row", F.explode("windows").alias("w")).select("row", "w.words", "w.size", "w.places")
    known = of_items.select("words").distinct()
    hits = cut_lineage(salted_join(candidates, known, ["words"], ["row"], heavy_keys(candidates, ["words"])))
    span = F.struct(F.col("begin"), (F.col("begin") + F.col("size")).alias("end"))
    spans = hits.select("row", "size", F.sha2("words", 256).alias("window_id"), F.explode("places").alias("begin")).groupBy("row")
    spans = spans.agg(F.array_sort(F.collect_set(span)).alias("spans"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_set("window_id"))), 256).alias("kind"))
    spans = cut_lineage(spans)
    # Documents with the same set of windows have the same items: one of each kind is looked up.
    first = spans.groupBy("kind").agg(F.min("row").alias("row"))
    of_kind = first.join(hits.select("row", "words"), "row").join(of_items.select("words", "item_id"), "words").filter(F.col("item_id").isNotNull())
    of_kind = of_kind.groupBy("kind").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    listed = salted_join(spans.select("row", "kind"), of_kind, ["kind"], ["row"]).select("row", "items")
    out = found.select("row", "doc_id", "n_words").join(spans.select("row", "spans"), "row", "left").join(listed, "row", "left")
    all_items, all_spans = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("spans", F.array().cast("array<struct<begin:int,end:int>>"))
    n_hit = _covered(all_spans)
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(all_items).cast("long").alias("n_items"), all_items.alias("items"), (n_hit > 0).alias("contaminated"), all_spans.alias("spans"))
