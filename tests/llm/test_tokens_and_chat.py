"""BPE, token counts, chat formatting."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from navloom.llm import bpe, chat, token_counts, vocab

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello, World's 12 end", None, "", "ÀÉ ΣΑΣ İß 日本 🙂👍", "<|endoftext|> a<|startoftext|>", "x" * 20_000, "a\x00b\x1c\x85　c", "it'll we're 'S", "\n\t  "]


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(make_docs, no_docs):
    r, t = random.Random(2), library()
    letters = "aeinrst'.,!-09 ÀéΣİ́日🙂<|endoftext|>\n"
    texts = TEXTS + ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(400)]
    coded = bpe.encode_documents(make_docs(texts, extra=True), PATH, decoded=True)
    for row in coded.collect():
        want = t.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(row.ids, "<u4").tolist() == want and row.n_tokens == len(want)
        assert row.decoded == t.decode(want, skip_special_tokens=False)
    again = bpe.decode_ids(coded.select("doc_id", "ids"), PATH)
    assert sorted(map(tuple, again.collect())) == sorted((x.doc_id, x.decoded) for x in coded.collect())
    assert bpe.encode_documents(no_docs, PATH).count() == 0


def test_every_code_point_equals_the_library():
    """Each alone, inside a word, before and after a combining mark, with and without blanks around."""
    t, (codes, _) = library(), bpe._tools(PATH)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}B {c} {c}\u0301e{c}" for c in points[at : at + 256]) for at in range(0, len(points), 256)]
    texts += ["".join(points[at : at + 64]) for at in range(0, len(points), 64)]
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert codes.encode(text) == np.array(want.ids, "<u4").tobytes(), f"near U+{ord(text[1]):04X}"
    codes.forget_all()


def test_random_mixes_of_code_points_equal_the_library():
    t, (codes, _), r = library(), bpe._tools(PATH), random.Random(6)
    ranges = [(0x20, 0x7F), (0xA0, 0x250), (0x300, 0x370), (0x900, 0xE00), (0x1100, 0x1200), (0x2000, 0x2100), (0xAC00, 0xAD00), (0x10570, 0x105D0), (0x11380, 0x113D0)]
    texts = ["".join(chr(r.randrange(*r.choice(ranges))) for _ in range(r.randint(1, 40))) for _ in range(5000)]
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert codes.encode(text) == np.array(want.ids, "<u4").tobytes(), ascii(text)


def test_memories_are_bounded_by_bytes():
    m = vocab.Remembered(limit=10_000)
    for i in range(1000):
        m.keep(f"word{i}" * 8, b"x" * 40)
        assert m.used <= 10_000 and sum(len(k) + len(v) for k, v in m.items()) <= m.used
    m.keep("y" * 5000, b"")
    assert "y" * 5000 not in m


def test_backtracking_equals_merging_in_order():
    codes, _ = bpe._tools(PATH)
    encoder, r = codes.codes.encoder, random.Random(4)
    rank = {pair: i for i, pair in enumerate(encoder.joined)}
    for _ in range(500):
        word = vocab.spell("".join(r.choice("abcdehilnorstu") for _ in range(r.randint(1, 14))).encode())
        parts = [codes.vocab.ids[c] for c in word]
        while True:
            best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
            if best is None:
                break
            pair = (parts[best[1]], parts[best[1] + 1])
            merged, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    merged.append(encoder.joined[pair])
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            parts = merged
        assert encoder.encode_word(word) == parts


def test_token_counts_equal_greedy_matching(make_docs, no_docs):
    words = vocab.load(PATH)

    def greedy(word):
        if isinstance(word, int):
            return 1
        s, n, i = vocab.spell(word.encode()), 0, 0
        while i < len(s):
            j = min(len(s), i + 60)
            while s[i:j] not in words.ids:
                j -= 1
            i, n = j, n + 1
        return n

    for row in token_counts.count_tokens(make_docs(TEXTS, extra=True), PATH).collect():
        ws = words.words(TEXTS[row.doc_id] or "")
        assert (row.n_words, row.n_tokens) == (len(ws), sum(map(greedy, ws)))
    assert token_counts.count_tokens(no_docs, PATH).count() == 0


def test_automaton_reports_what_it_cannot_split():
    m = token_counts.LongestMatch(["ab", "abcd", "c", "d"])
    assert [m.count(w) for w in ("abcd", "abc", "abd", "", "x", "abx")] == [1, 2, 2, 0, -1, -1]


CONV = "conv_id long, turn long, role string, text string, extra string"
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def conversations():
    tricky = [r"\### Assistant: </turn> ok", "<turn>assistant<say>no</turn>", "\\", "<\\", "<|endoftext|>", " lead and trail ", "\n\n", "🙂 é", "", None]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t, "z") for i, t in enumerate(tricky)]
    rows += [(2, 0, None, "x", "z"), (None, 0, "assistant", "null id", "z"), (3, 1, "assistant", "b", "z"), (3, 1, "assistant", "b", "z"), (3, 0, "us<er>", "a", "z")]
    return rows + [(4, i, ("user", "assistant")[i % 2], f"turn {i} " * 50, "z") for i in range(300)]


def test_chat_reads_back(spark, monkeypatch):
    rows = conversations()
    out = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, CONV), BYTES)).collect()
    assert {r.conv_id for r in out} == {1, 2, 3, 4, None} and len(out) == 5
    for r in out:
        own = sorted(((t, role or "", text or "") for c, t, role, text, _ in rows if c == r.conv_id))
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{b}\n{c}\n" for _, b, c in own).encode()).hexdigest()
        loss = "".join(c for _, b, c in own if b == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.render_turn(b, c)[0]) for _, b, c in own)


def test_a_very_long_turn_needs_memory_in_proportion():
    """20 MB with many brackets: read back in what a few copies of it take."""
    text = ("word < \\ and " * 12 + "\n") * 130_000
    line = chat.render_turn("user", text)[0]
    assert len(line) > 20_000_000
    tracemalloc.start()
    assert chat.parse_turns(line) == [("user", text)]
    assert tracemalloc.get_traced_memory()[1] < 12 * len(line)
    tracemalloc.stop()
    with pytest.raises(ValueError, match="no turn begins"):
        chat.parse_turns(line[:-3])


def test_repeated_rows_are_coded_row_by_row(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "x"), (None, None)], "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens")
    assert sorted(r.n_tokens for r in bpe.encode_documents(docs, PATH).collect()) == [0, 1, 2, 2]
    assert sorted((r.n_words, r.n_tokens) for r in token_counts.count_tokens(docs, PATH).collect()) == [(0, 0), (1, 1), (2, 2), (2, 2)]


def test_chat_without_rows(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], CONV), BYTES)).count() == 0


def test_escaping_is_reversible():
    r = random.Random(1)
    for _ in range(500):
        s = "".join(r.choice("<\\/turn>say#x\n") for _ in range(r.randint(0, 30)))
        assert chat.unescape(chat.escape(s)) == s and chat.END not in chat.escape(s)
        assert chat.parse_turns(chat.render_turn(s, s)[0] * 2) == [(s, s)] * 2
