"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

For a word, an Aho-Corasick automaton finds the longest piece at every position. The encoder takes longest
pieces, checks each against the piece before it in a pair-compatibility table (would merging in order ever
have joined across that border?), falls back to the piece's next shorter prefix, and steps back where none
fits; a position that failed once is never tried again, so a word takes linear time. The result is exactly
what merging pairs in order gives. Decoding copies slices of one byte string that holds all pieces.

Defined cases
    * null text counts as empty; empty text has no tokens and decodes to the empty string;
    * very long words need no recursion; repeated rows and null ids are encoded like any other;
    * empty table: empty result; only the id and text columns are read, so other columns' names don't matter.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.llm.common import small_batches
from navloom.llm.vocab import Remembered, Vocabulary, chunks, load, spell

#: Pairs of pieces whose compatibility a task remembers at most; the memory is emptied when full.
REMEMBERED_PAIRS = 200_000
ROWS_AT_ONCE = 256


class Encoder:
    def __init__(self, vocab: Vocabulary) -> None:
        ids, spelled = vocab.ids, vocab.spelled
        letters = {vocab.written[i]: s for i, s in spelled.items()}
        # Pieces that no merge makes split into themselves. Later pieces come from later merges.
        self.rank = {i: -1 for i in spelled}
        self.halves = {i: (i, i) for i in spelled}
        self.joined: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(vocab.merges):
            left, right = ids[letters[a]], ids[letters[b]]
            whole = ids[letters[a] + letters[b]]
            self.joined[left, right] = whole
            self.rank[whole], self.halves[whole] = rank, (left, right)
        self.compatible: dict[tuple[int, int], bool] = {}
        # A merged piece is a token only if merging in order makes it from its letters.
        self.whole = {s: i for s, i in ids.items() if self.rank[i] < 0 or self._apart_until(*self.halves[i], self.rank[i])}
        self.length = {i: len(s) for s, i in self.whole.items()}
        self.shorter = {i: next((self.whole[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.whole), None) for s, i in self.whole.items()}
        self.matcher = ahocorasick.Automaton()
        for s, i in self.whole.items():
            self.matcher.add_word(s, (i, len(s)))
        self.matcher.make_automaton()

    def _apart_until(self, left: int, right: int, end: float) -> bool:
        """Whether merging in order leaves the border between two pieces alone before the merge numbered ``end``."""
        while True:
            whole = self.joined.get((left, right))
            if whole is not None and self.rank[whole] < end:
                return False
            # Undo the later of the two merges; the pair before it must not have joined sooner.
            if self.rank[left] < 0 and self.rank[right] < 0:
                return True
            if self.rank[left] > self.rank[right]:
                end, left = self.rank[left], self.halves[left][1]
            else:
                # The merge on the right has the same number or a later one: an equal pair on the left goes first.
                end, right = self.rank[right] + 1, self.halves[right][0]

    def fits(self, left: int, right: int) -> bool:
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) >= REMEMBERED_PAIRS:
                self.compatible.clear()
            known = self.compatible[left, right] = self._apart_until(left, right, float("inf"))
        return known

    def encode_word(self, symbols: str) -> list[int]:
        whole = self.whole.get(symbols)
        if whole is not None:
            return [whole]
        n = len(symbols)
        longest = [0] * n
        for end, (i, size) in self.matcher.iter(symbols):
            longest[end - size + 1] = i  # ends ascend, so the last match at a start is the longest
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            piece: int | None = token
            before = out[-1] if out else None
            while piece is not None and not (open_at[at + self.length[piece]] and (before is None or self.fits(before, piece))):
                piece = self.shorter[piece]
            if piece is not None:
                out.append(piece)
                at += self.length[piece]
                token = longest[at] if at < n else 0
            else:
                open_at[at] = 0
                token = out.pop()
                at -= self.length[token]
        return out


class WordCodes(Remembered):
    """Word -> its token ids as little-endian unsigned 32-bit integers, worked out when first met."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str | int) -> bytes:
        if isinstance(word, int):
            code = word.to_bytes(4, "little")
        else:
            ids = self.encoder.encode_word(spell(word.encode("utf-8", "surrogatepass")))
            code = struct.pack(f"<{len(ids)}I", *ids)
        self.keep(word, code)
        return code


class ChunkCodes(Remembered):
    """The same for the chunks between blanks."""

    def __init__(self, vocab: Vocabulary, words: WordCodes) -> None:
        super().__init__()
        self.vocab, self.codes = vocab, words

    def __missing__(self, chunk: str) -> bytes:
        code = b"".join([self.codes[w] for w in self.vocab.words(chunk)])
        self.keep(chunk, code)
        return code

    def forget_all(self) -> None:
        """Free what a partition has taught; the next task of this process may be of another kind."""
        self.forget()
        self.codes.forget()
        self.codes.encoder.compatible.clear()
        pa.default_memory_pool().release_unused()

    def encode(self, text: str | None) -> bytes:
        return b"".join([self[c] for c in chunks(text)]) if text else b""


class Decoder:
    """All written pieces in one byte string, each with the blank that parts it from the next, and where each begins."""

    def __init__(self, vocab: Vocabulary) -> None:
        pieces = [(vocab.written.get(i, "") + " ").encode("utf-8") for i in range(max(vocab.written) + 1)]
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        starts = self.offsets[ids]
        sizes = self.offsets[ids + np.uint32(1)] - starts
        ends = np.cumsum(sizes)
        where = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
        return self.bytes[where].tobytes()[:-1]


@lru_cache(maxsize=1)
def _tools(path: str) -> tuple[ChunkCodes, Decoder]:
    vocab = load(path)
    return ChunkCodes(vocab, WordCodes(Encoder(vocab))), Decoder(vocab)


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit, as binary) of each whole text; with ``decoded``, the text that the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, decoder = _tools(vocab_path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                ids = [codes.encode(t) for t in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([decoder.decode(np.frombuffer(x, "<u4")).decode("utf-8") for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])
        codes.forget_all()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary"
    return rows.mapInArrow(run, schema + (", decoded string" if decoded else ""))


def decode_ids(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the decoded text of ids as ``encode_documents`` writes them; null ids decode to the empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _tools(vocab_path)[1]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                texts = [decoder.decode(np.frombuffer(x or b"", "<u4")).decode("utf-8") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded string")
