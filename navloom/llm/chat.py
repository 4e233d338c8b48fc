"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as ``<turn>role<say>text</turn>`` lines. In roles and texts ``\\`` becomes ``\\\\`` and ``<``
becomes ``<\\``, so no marker can occur inside them and the rendering can be read back. The rendering is encoded once,
with character offsets; the tokens under the loss are found by binary search of each assistant turn's span in the
sorted token offsets. The three markers are tokens of their own, so no token crosses the border of a turn.

Rows are ranged by conversation and turn, so even a conversation that holds a third of all rows is rendered by many
tasks; it then comes in pieces, numbered in order and cut between turns. Reading back takes digests over a whole
conversation, so its pieces meet in one task, which holds one of them at a time.

Defined cases
    * null text or role counts as empty; turns are ordered by turn (null first), then role, then text;
    * repeated rows are turns like any other; rows of a null conv_id are one conversation;
    * an empty assistant text has no tokens under the loss; very long turns are one piece each;
    * empty table: empty result; only the four named columns are read, so other columns' names don't matter.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.llm.common import small_batches

TURN, SAY, END = "<turn>", "<say>", "</turn>"
PIECE_CHARS = 1 << 18
PIECES_AT_ONCE = 64

# Possessive runs: a turn of any length is matched without a note for each character.
_ESCAPED = r"[^<]*+(?:<\\[^<]*+)*+"
_TURN_RE = re.compile(rf"{TURN}({_ESCAPED}){SAY}({_ESCAPED}){END}\n")
_ESCAPED_RE = re.compile(r"<\\|\\\\")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "<\\")


def unescape(text: str) -> str:
    return _ESCAPED_RE.sub(lambda m: m[0][0], text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The rendered line, and where its text begins and ends in it."""
    head = f"{TURN}{escape(role)}{SAY}"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each rendered turn."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN_RE.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn begins at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens meet one of the sorted spans."""
    mask = np.zeros(len(starts), bool)
    for begin, end in spans:
        if begin < end:
            mask[np.searchsorted(ends, begin, "right") : np.searchsorted(starts, end, "left")] = True
    return mask


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """All text under the mask, unescaped: each run of masked tokens is one stretch of it."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return "".join(unescape(formatted[starts[a] : ends[b - 1]]) for a, b in zip(edges[::2], edges[1::2], strict=True))


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> Any:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(m, normalized=False) for m in (TURN, SAY, END)])
    t.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets that cover blanks too
    t.no_truncation()
    t.no_padding()
    return t


def _encoded(pieces: list[tuple[Any, int, int, str, list[tuple[int, int]]]], conv_type: pa.DataType, path: str) -> pa.RecordBatch:
    columns: list[list[Any]] = [[] for _ in range(8)]
    for (conv, number, turns, text, spans), e in zip(pieces, _tokenizer(path).encode_batch([p[3] for p in pieces], add_special_tokens=False), strict=True):
        offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
        mask = loss_mask(offsets[:, 0], offsets[:, 1], spans)
        for column, value in zip(columns, (conv, number, turns, text, e.ids, offsets[:, 0], offsets[:, 1], mask), strict=True):
            column.append(value)
    numbers = pa.list_(pa.int32())
    kinds = (conv_type, pa.int64(), pa.int32(), pa.string(), numbers, numbers, numbers, pa.list_(pa.bool_()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "piece", "turns", "formatted", "ids", "starts", "ends", "loss"])


def format_conversations(rows: DataFrame, tokenizer_path: str, loss_role: str = "assistant") -> DataFrame:
    """conv_id, piece, turns, formatted, token ids, their character offsets (starts, ends), and the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        done, size, lines, spans, now = [], 0, [], [], None
        conv_type = None
        for batch in batches:
            conv_type = batch.schema.field(0).type
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if lines and (conv != now or size >= PIECE_CHARS):
                    done.append((now, number, len(lines), "".join(lines), spans))
                    number, size, lines, spans = number + 1, 0, [], []
                    if len(done) >= PIECES_AT_ONCE or sum(len(p[3]) for p in done) >= PIECE_CHARS:
                        yield _encoded(done, conv_type, tokenizer_path)
                        done = []
                now = conv
                line, begin, end = render_turn(role, text)
                if role == loss_role:
                    spans.append((size + begin, size + end))
                lines.append(line)
                size += len(line)
        if lines:
            done.append((now, number, len(lines), "".join(lines), spans))
        if done:
            yield _encoded(done, conv_type, tokenizer_path)

    small_batches(rows.sparkSession)
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = clean.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = clean.schema["conv_id"].dataType.simpleString()
    return ranged.mapInArrow(run, f"conv_id {kind}, piece long, turns int, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>")


def read_back(formatted: DataFrame) -> DataFrame:
    """From the output of ``format_conversations`` alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        conv_type, now, state, out = None, None, None, []

        def close() -> None:
            if state is not None:
                out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def packed() -> pa.RecordBatch:
            kinds = (conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            conv_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, PIECES_AT_ONCE):
                part = batch.slice(at, PIECES_AT_ONCE)
                for i, (conv, text) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    if state is None or conv != now:
                        close()
                        now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    turns = parse_turns(text)
                    starts, ends, mask = (part.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (3, 4, 5))
                    loss = masked_text(text, starts, ends, mask.astype(bool))
                    state[0] += len(turns)
                    state[1].update("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8"))
                    state[2] += len(loss)
                    state[3].update(loss.encode("utf-8"))
                    state[4] += len(text)
                if len(out) >= 1000:
                    yield packed()
                    out.clear()
        close()
        if out:
            yield packed()

    kind = formatted.schema["conv_id"].dataType.simpleString()
    pieces = formatted.select("conv_id", "piece", "formatted", "starts", "ends", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return pieces.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
