"""Token counts by a linear longest-match automaton.

Greedy word-piece splitting takes the longest piece that starts a word, then the longest that starts the rest.
The automaton is the vocabulary's trie with two notes per node: where matching goes on when the next symbol has
no branch (failure link), and how many pieces that step settles (popped count). A word then costs one walk over
its symbols, and no piece is ever built.

Defined cases
    * null text counts as empty, with no words and no tokens; repeated rows and null ids are counted like any other;
    * every symbol is a piece, so every word can be split; very long words take linear time;
    * empty table: empty result; only the id and text columns are read, so other columns' names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.llm.common import small_batches
from navloom.llm.vocab import Remembered, Vocabulary, chunks, load, spell

ROWS_AT_ONCE = 256


class LongestMatch:
    def __init__(self, pieces: Iterable[str]) -> None:
        self.branches: list[dict[str, int]] = [{}]
        piece_at = [False]
        for piece in pieces:
            node = 0
            for symbol in piece:
                nxt = self.branches[node].get(symbol)
                if nxt is None:
                    nxt = self.branches[node][symbol] = len(self.branches)
                    self.branches.append({})
                    piece_at.append(False)
                node = nxt
            piece_at[node] = True
        self.fail = [-1] * len(self.branches)
        self.popped = [0] * len(self.branches)
        level = [0]
        while level:  # nodes in the order of depth: a failure link leads to a shallower node
            below = []
            for parent in level:
                for symbol, node in self.branches[parent].items():
                    below.append(node)
                    if piece_at[node]:
                        self.fail[node], self.popped[node] = 0, 1
                        continue
                    to, count = self.fail[parent], self.popped[parent]
                    while to >= 0 and symbol not in self.branches[to]:
                        count += self.popped[to]
                        to = self.fail[to]
                    self.fail[node] = self.branches[to][symbol] if to >= 0 else -1
                    self.popped[node] = count
            level = below

    def count(self, symbols: str) -> int:
        """Pieces of the word; -1 if some part of it is no piece."""
        node = count = 0
        branches, fail, popped = self.branches, self.fail, self.popped
        for symbol in symbols:
            while (nxt := branches[node].get(symbol)) is None:
                if fail[node] < 0:
                    return -1
                count += popped[node]
                node = fail[node]
            node = nxt
        while node > 0:
            count += popped[node]
            node = fail[node]
        return count if node == 0 else -1


class WordCounts(Remembered):
    def __init__(self, matcher: LongestMatch) -> None:
        super().__init__()
        self.matcher = matcher

    def __missing__(self, word: str | int) -> int:
        if isinstance(word, int):
            count = 1
        else:
            count = self.matcher.count(spell(word.encode("utf-8", "surrogatepass")))
        self.keep(word, count)
        return count


class ChunkCounts(Remembered):
    """Words and tokens of the chunks between blanks, packed into one number: words * 2**32 + tokens."""

    def __init__(self, vocab: Vocabulary, words: WordCounts) -> None:
        super().__init__()
        self.vocab, self.counts = vocab, words

    def __missing__(self, chunk: str) -> int:
        words = self.vocab.words(chunk)
        packed = (len(words) << 32) + sum([self.counts[w] for w in words])
        self.keep(chunk, packed)
        return packed

    def forget_all(self) -> None:
        """Free what a partition has taught."""
        self.forget()
        self.counts.forget()

    def count(self, text: str | None) -> int:
        return sum([self[c] for c in chunks(text)]) if text else 0


@lru_cache(maxsize=1)
def _tools(path: str) -> ChunkCounts:
    vocab = load(path)
    return ChunkCounts(vocab, WordCounts(LongestMatch(vocab.ids)))


def count_tokens(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and n_tokens of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _tools(vocab_path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                packed = [counts.count(t) for t in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array([p >> 32 for p in packed], pa.int64()), pa.array([p & 0xFFFFFFFF for p in packed], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_tokens"])
        counts.forget_all()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
