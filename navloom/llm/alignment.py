"""Alignment of two tokenizers over the same bytes, and corpus-wide counts of the token pairs it links.

Each text, with a blank before it, is encoded by a byte-level BPE (A) and a piece model with byte fallback (B). Sizes of
tokens in bytes are looked up and summed (``cumsum``); the offsets at which tokens of both end (``intersect1d``) cut the
text into groups; a token's group is found by binary search (``searchsorted``). A and B tokens of one group are linked;
the links are expanded by ``repeat`` from the distinct ids of each group, with their multiplicity, a bounded number at a
time. Every task counts its documents' pairs before anything is shuffled; counts are then added by pair and salt, and by
pair. To bring counts back to documents, the heaviest pairs (``BROADCAST_PAIRS`` of them at most, so of bounded size) are
broadcast and looked up in sorted arrays; links of all other pairs are joined by pair, and lose nothing.

Tokenizer A is run by the rank encoder over the ranks that the vocabulary file states, which gives the same ids on every
code point (tested) in a fifth of the time.

Defined cases
    * null and empty texts have no tokens: all numbers are 0 and the digest is the empty string; so it is where the joined
      bytes of the tokens are not the text's;
    * repeated rows, whatever their ids, are documents of their own, and null ids are ids like any other;
    * empty table: empty result; only the id and text columns are read, so other columns' names don't matter.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navloom.llm.common import cut_lineage, small_batches
from navloom.llm.vocab import byte_letters

#: Pairs whose counts every task holds: 17 bytes each.
BROADCAST_PAIRS = 200_000
#: Salts of the first of the two sums.
SALTS = 16
#: Links expanded at a time, and pairs a task counts before it passes them on.
LINKS_AT_ONCE, PAIRS_AT_ONCE = 1 << 22, 1 << 20
TEXTS_AT_ONCE = 32
NO_IDS = np.zeros(0, np.int64)


class ByteLevel:
    """A byte-level BPE vocabulary file (JSON) as ranks: ids ascend in the order of merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, special = byte_letters(), {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(spec["model"]["vocab"].values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(b) for b in ranks]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.int64)


class Pieces:
    """A sentencepiece model that adds a blank before a text and spells unknown letters in bytes."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode("utf-8") for i, n in enumerate(names)]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Decimals:
    """Numbers as text, each with a comma after it, in one byte string."""

    def __init__(self, count: int) -> None:
        words = [f"{i},".encode() for i in range(count)]
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.ends = np.cumsum([len(w) for w in words])
        self.sizes = np.array([len(w) for w in words], np.int64)

    def written(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, and where each number's comma is."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        where = np.arange(ends[-1]) + np.repeat(self.ends[ids] - ends, sizes)
        return self.bytes[where], ends - 1


def aligned(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each A token and of each B token, from where their bytes end; and how many groups there are."""
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), len(cuts)


def _distinct(ids: np.ndarray, groups: np.ndarray, n_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of each group: ids, groups (ascending) and how often."""
    keys, times = np.unique(groups * n_ids + ids, return_counts=True)
    return keys % n_ids, keys // n_ids, times


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sum of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(values, first)


def linked(a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, groups: int, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked pairs as ``a * n_b + b``, ascending, and how many links each has."""
    a, group_a, times_a = _distinct(a, group_a, n_a)
    b, group_b, times_b = _distinct(b, group_b, n_b)
    first = np.searchsorted(group_b, np.arange(groups + 1))
    fan = np.diff(first)[group_a]
    reach = np.cumsum(fan)
    keys, times, at = NO_IDS, NO_IDS, 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + LINKS_AT_ONCE)))
        part = fan[at:to]
        begin = np.repeat(np.cumsum(part) - part, part)
        other = np.repeat(first[group_a[at:to]], part) + np.arange(len(begin)) - begin
        keys, times = summed(np.append(keys, np.repeat(a[at:to], part) * n_b + b[other]), np.append(times, np.repeat(times_a[at:to], part) * times_b[other]))
        at = to
    return keys, times


def group_digest(a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, groups: int, decimals: Decimals) -> str:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3``: the ids of each group in order."""
    until_a, until_b = (np.searchsorted(g, np.arange(groups), side="right") for g in (group_a, group_b))
    place_a = np.arange(len(a)) + np.append(0, until_b[:-1])[group_a]
    place_b = np.arange(len(b)) + until_a[group_b]
    ids = np.empty(len(a) + len(b), np.int64)
    ids[place_a], ids[place_b] = a, b
    text, commas = decimals.written(ids)
    text[commas[until_a + np.append(0, until_b[:-1]) - 1]] = ord("|")
    text[commas[until_a + until_b - 1]] = ord(";")
    return hashlib.sha256(text[:-1]).hexdigest()


@lru_cache(maxsize=1)
def _tools(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces, Decimals]:
    a, b = ByteLevel(path_a), Pieces(path_b)
    return a, b, Decimals(max(len(a.sizes), len(b.sizes)))


def key_type(n_a: int, n_b: int) -> str:
    return "<u4" if n_a * n_b < 1 << 32 else "<u8"


NOTHING = (0, 0, 0, 0, "", b"", b"")


def _row(text: str, b_ids: list[int], tools: tuple[ByteLevel, Pieces, Decimals]) -> tuple:
    first, second, decimals = tools
    data = (" " + text).encode("utf-8")
    if not text or b"".join([second.bytes[i] for i in b_ids]) != data:
        return NOTHING
    a, b = first.encode(" " + text), np.array(b_ids, np.int64)
    ends_a, ends_b = np.cumsum(first.sizes[a]), np.cumsum(second.sizes[b])
    if ends_a[-1] != len(data):
        return NOTHING
    group_a, group_b, groups = aligned(ends_a, ends_b)
    keys, times = linked(a, group_a, b, group_b, groups, len(first.sizes), len(second.sizes))
    packed = keys.astype(key_type(len(first.sizes), len(second.sizes))).tobytes(), times.astype("<u8").tobytes()
    return len(a), len(b), groups, int(times.sum()), group_digest(a, group_a, b, group_b, groups, decimals), *packed


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``, written once: row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct pairs with their links (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _tools(path_a, path_b)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = [_row(t, ids, tools) for t, ids in zip(texts, tools[1].encode(texts), strict=True)]
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")
    return cut_lineage(found.withColumn("row", F.monotonically_increasing_id()))


def pair_counts(found: DataFrame, n_b: int, keys: str) -> DataFrame:
    """(pair, docs, best) of rows of ``align_documents``: in how many documents a pair is linked, and whether no pair of its A id is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, docs, waiting, held = NO_IDS, NO_IDS, [], 0

        def counted() -> tuple[np.ndarray, np.ndarray]:
            more, times = np.unique(np.concatenate([NO_IDS, *waiting]), return_counts=True)
            return summed(np.append(pairs, more), np.append(docs, times))

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(docs, pa.int64())], ["pair", "docs"])

        for batch in batches:
            for x in batch.column(0).to_pylist():
                waiting.append(np.frombuffer(x, keys).astype(np.int64))
                held += len(waiting[-1])
                if held >= 2 * PAIRS_AT_ONCE:
                    (pairs, docs), waiting, held = counted(), [], 0
                    if len(pairs) >= PAIRS_AT_ONCE:
                        yield packed()
                        pairs, docs = NO_IDS, NO_IDS
        pairs, docs = counted()
        yield packed()

    parts = found.select("pairs").mapInArrow(run, "pair long, docs long").withColumn("salt", F.spark_partition_id() % SALTS)
    salted = parts.groupBy("pair", "salt").agg(F.sum("docs").alias("docs"))
    counts = salted.groupBy("pair").agg(F.sum("docs").alias("docs"))
    # An A id has as many pairs as there are B ids at most.
    most = F.max("docs").over(Window.partitionBy(F.floor(F.col("pair") / n_b)))
    return cut_lineage(counts.select("pair", "docs", (F.col("docs") == most).alias("best")))


def alignment_sums(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best`` counts links whose pair is in as many documents as any pair of its A id; ``count_sum`` adds the number of
    documents of its pair over all links.
    """
    spark = docs.sparkSession
    first, second, _ = _tools(path_a, path_b)
    keys = key_type(len(first.sizes), len(second.sizes))
    found = align_documents(docs, path_a, path_b, id_col, text_col)
    counts = pair_counts(found, len(second.sizes), keys)
    top = counts.orderBy(F.desc("docs"), "pair").limit(broadcast_pairs).toArrow()
    columns = [np.asarray(top.column(c).to_numpy()) for c in ("pair", "docs", "best")]
    order = np.argsort(columns[0])
    heavy = spark.sparkContext.broadcast([c[order] for c in columns])

    def looked_up(pairs: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known, ids = heavy.value[0], np.frombuffer(pairs, keys).astype(np.int64)
        at = np.searchsorted(known, ids)
        at[at == len(known)] = 0
        return ids, at, known[at] == ids if len(known) else np.zeros(len(ids), bool)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pairs, times in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                _, at, inside = looked_up(pairs)
                links, at = np.frombuffer(times, "<u8").astype(np.int64)[inside], at[inside]
                out.append((int(links[heavy.value[2][at]].sum()), int((links * heavy.value[1][at]).sum())) if len(at) else (0, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], pa.int64()) for i in (0, 1))], ["row", "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, pairs, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids, _, inside = looked_up(pairs)
                if not inside.all():
                    rest = ids[~inside]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rest), row)), pa.array(rest), pa.array(np.frombuffer(times, "<u8").astype(np.int64)[~inside])], ["row", "pair", "times"])

    coded = found.select("row", "pairs", "times")
    near = coded.mapInArrow(sums, "row long, n_best long, count_sum long")
    if len(columns[0]) < broadcast_pairs:
        total = near  # all pairs are broadcast
    else:
        far = coded.mapInArrow(others, "row long, pair long, times long").join(counts, "pair")
        far = far.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
        total = near.unionByName(far).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.join(total, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
