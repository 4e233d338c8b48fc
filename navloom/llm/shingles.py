"""Sets of word shingles as 64-bit hashes, computed for many texts at once in numpy.

Words are runs of bytes outside ASCII white space, with A-Z in lower case. A text's set holds the hashes of its
distinct runs of ``words`` words; a shorter text has its whole word sequence as the only one; a text without words
has the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_random = np.random.default_rng(20240607)
_LETTER = _random.integers(1, 2**64, 256, np.uint64, endpoint=False)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]
_STEP = np.uint64(int(_random.integers(1, 2**62)) * 2 + 1)
_PLACES = _random.integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
BYTES_AT_ONCE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parts(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about ``BYTES_AT_ONCE``, with where they begin; at least one text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES_AT_ONCE)))
        yield at, texts.slice(at, to - at)
        at = to


def words_and_starts(texts: pa.Array, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice of texts, with words parted by the bytes marked in ``space``: word hashes, first bytes and sizes in order,
    where each text's words begin (one more for the end), all bytes, and where each text's bytes begin."""
    # A fresh array: its offsets then begin at the data's.
    filled = pa.array([b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()], pa.large_binary())
    _, offsets, data = filled.buffers()
    bounds = np.frombuffer(offsets, np.int64)[: len(filled) + 1]
    letters = np.frombuffer(data, np.uint8)[: bounds[-1]] if bounds[-1] else np.zeros(0, np.uint8)
    solid = ~space[letters]
    where = np.flatnonzero(solid)
    if not len(where):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(filled) + 1, np.int64), letters, bounds
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = bounds[:-1][bounds[:-1] < bounds[-1]]
    first[begins] |= solid[begins]
    starts = np.flatnonzero(first[where])
    sizes = np.diff(np.append(starts, len(where)))
    powers = np.cumprod(np.full(int(sizes.max()), _STEP, np.uint64))
    place = np.arange(len(where)) - np.repeat(starts, sizes)
    hashes = mix(np.add.reduceat(_LETTER[letters[where]] * powers[place], starts) + sizes.astype(np.uint64))
    owner = np.searchsorted(bounds, where[starts], side="right") - 1
    return hashes, where[starts], sizes, np.searchsorted(owner, np.arange(len(filled) + 1)), letters, bounds


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same without the first bytes, for words parted by white space."""
    hashes, _, sizes, edges, letters, bounds = words_and_starts(texts, _SPACE)
    return hashes, sizes, edges, letters, bounds


def rolled(hashes: np.ndarray, words: int) -> np.ndarray:
    """The hash of each run of ``words`` words."""
    out = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for i in range(words):
        out += hashes[i : len(hashes) - words + 1 + i] * _PLACES[i]
    return mix(out)


def _some_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    hashes, _, edges, _, _ = words_of(texts)
    runs, out = rolled(hashes, words), []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            # The number of words goes in too, as one more word.
            whole = np.append(hashes[a:b], np.uint64(b - a)) * np.append(_PLACES[: b - a], _PLACES[-1])
            out.append(mix(np.add.reduce(whole, keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted set of each text, in order; memory is bounded by one slice of texts."""
    for _, part in parts(texts):
        yield from _some_sets(part, words)


def shared_with(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which members of the set ``a`` the sorted set ``b`` holds."""
    if not len(b):
        return np.zeros(len(a), bool)
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return b[at] == a
