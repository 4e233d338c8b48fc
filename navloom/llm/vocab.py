"""A word-level byte vocabulary read from a public tokenizer file, and its way of splitting text into words.

The file's path is always a parameter. Text is normalised (NFC, white space runs to one space, lower case letter
by letter) and split into words; a word is spelled as byte symbols, its last byte as a symbol of its own kind,
because the vocabulary marks word ends. So 512 symbols spell every word, and all of them are pieces.

Which characters are letters, digits or blanks, how they compose and what their lower case is depends on the
Unicode version. Text beyond ASCII is therefore normalised and cut by the tokenizer library's own functions, so
that no character is classed by another version than the vocabulary's library uses.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

from tokenizers import Regex, normalizers, pre_tokenizers

# The splitting pattern and the mark of a word's end as the tokenizer file format names them.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: The same pattern for text in lower-case ASCII.
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x20\x09-\x0Da-z0-9]+")

#: What a task's memory of words or chunks may hold, in bytes as estimated; it is emptied when full.
REMEMBERED_BYTES = 48_000_000
#: Chunks longer than this are not remembered; they hardly come twice.
REMEMBERED_LENGTH = 64
#: What an entry of a dictionary takes beside the letters of its key and its value.
ENTRY_BYTES = 150


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones for themselves, the rest from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def spell(data: bytes) -> str:
    """Symbols of a word: chr(byte), and chr(byte + 256) for the last byte."""
    s = data.decode("latin-1")
    return s[:-1] + chr(ord(s[-1]) + 256)


class Vocabulary:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.ids: dict[str, int] = {}
        self.written: dict[int, str] = {}
        for token, i in spec["model"]["vocab"].items():
            self.written[i] = token
            ends = token.endswith(WORD_END) and token != WORD_END
            data = bytes(letters[c] for c in (token[: -len(WORD_END)] if ends else token))
            self.ids[spell(data) if ends else data.decode("latin-1")] = i
        self.spelled = {i: s for s, i in self.ids.items()}
        self.merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.written |= {i: t for t, i in self.special.items()}
        self._special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._first = re.compile("[" + re.escape("".join(sorted({t[0] for t in self.special}))) + "]") if self.special else None
        self._normal = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        self._cut = pre_tokenizers.Split(Regex(WORD_PATTERN), "removed", invert=True)

    def _plain_words(self, text: str) -> list[str]:
        if text.isascii():
            return ASCII_WORD.findall(text.lower())
        return [w for w, _ in self._cut.pre_tokenize_str(self._normal.normalize_str(text))]

    def words(self, text: str) -> list[str | int]:
        """Normalised words in order; a special token that the text spells out comes as its id.

        No word, special token or composed letter spans a blank, so a text's words are those of its chunks.
        """
        if self._special is None or not self._first.search(text):
            return self._plain_words(text)
        out: list[str | int] = []
        for i, part in enumerate(self._special.split(text)):
            if i % 2:
                out.append(self.special[part])
            elif part:
                out.extend(self._plain_words(part))
        return out


class Remembered(dict):
    """Answers by key, of bounded size in bytes."""

    def __init__(self, limit: int = REMEMBERED_BYTES) -> None:
        super().__init__()
        self.limit, self.used = limit, 0

    def keep(self, key: str | int, answer: bytes | int) -> None:
        if isinstance(key, int):
            size = ENTRY_BYTES
        elif len(key) > REMEMBERED_LENGTH:
            return
        else:
            size = ENTRY_BYTES + (1 if key.isascii() else 4) * len(key) + (len(answer) if isinstance(answer, bytes) else 0)
        if self.used + size > self.limit:
            self.forget()
        self.used += size
        self[key] = answer

    def forget(self) -> None:
        self.clear()
        self.used = 0


def chunks(text: str) -> list[str]:
    """The parts between blanks and line ends; much fewer different ones than there are texts."""
    return text.replace("\n", " ").split(" ")


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)
