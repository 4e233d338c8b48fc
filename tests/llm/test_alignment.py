from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from navloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(texts):
    """The contract's rows, by loops over the two libraries."""
    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    shown = alignment.byte_letters()
    rows, links, counts = [], [], Counter()
    for text in texts:
        row, found = [0, 0, 0, 0, ""], Counter()
        if text:
            data = (" " + text).encode()
            a, b = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)
            bytes_a = [bytes(shown[c] for c in ta.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, tb.id_to_piece(i)) for i in b)]
            if b"".join(bytes_a) == data == b"".join(bytes_b):
                groups, i, j, at_a, at_b, now = [], 0, 0, 0, 0, ([], [])
                while i < len(a) or j < len(b):
                    if at_a <= at_b and i < len(a) or j == len(b):
                        now[0].append(a[i])
                        at_a += len(bytes_a[i])
                        i += 1
                    else:
                        now[1].append(b[j])
                        at_b += len(bytes_b[j])
                        j += 1
                    if at_a == at_b:
                        groups.append(now)
                        now = ([], [])
                for x, y in groups:
                    found.update((p, q) for p in x for q in y)
                shape = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
                row = [len(a), len(b), len(groups), sum(found.values()), hashlib.sha256(shape.encode()).hexdigest()]
        rows.append(row)
        links.append(found)
        counts.update(found.keys())
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return [(*r[:4], sum(n for p, n in f.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in f.items()), r[4]) for r, f in zip(rows, links, strict=True)]


def texts_of(words):
    r = random.Random(4)
    prose = [" ".join(r.choice(words) for _ in range(r.randint(1, 80))) for _ in range(60)]
    return [*prose, prose[0], None, "", " ", "  two  blanks ", "\n\n x\t y\r\n", "<|endoftext|> <s> </s> <0x41> <unk>", "naïve café ▁ x", "中文字符 \U0001f600\U0001f44d\U0001f3fd", "a\x00b", "x" * 20_000, "=" * 999 + "-" * 777, "1234567890 " * 300, "don't we'll I'm"]


@pytest.mark.parametrize("broadcast_pairs", [0, 40, 200_000])
def test_sums_match_plain_loops(make_docs, words, broadcast_pairs):
    texts = texts_of(words)
    got = {r.doc_id: r[1:] for r in alignment.alignment_sums(make_docs(texts, extra=True), A, B, broadcast_pairs=broadcast_pairs).collect()}
    assert [tuple(got[i]) for i in range(len(texts))] == plain(texts)


def test_rows_without_ids_and_empty_tables(spark, no_docs):
    docs = spark.createDataFrame([(None, "some text"), (None, "some text"), (None, None), (3, "some text")], "doc_id long, text string")
    got = sorted(alignment.alignment_sums(docs, A, B).collect(), key=str)
    assert [(r.doc_id, r.n_a, r.n_best, r.count_sum) for r in got if r.n_a] == [(3, 2, 2, 6), (None, 2, 2, 6), (None, 2, 2, 6)]
    assert alignment.alignment_sums(no_docs, A, B).collect() == []


def test_links_are_the_same_in_small_steps(monkeypatch):
    r = np.random.default_rng(3)
    a, b = r.integers(0, 9, 300), r.integers(0, 7, 200)
    ga, gb = np.sort(r.integers(0, 20, 300)), np.sort(r.integers(0, 20, 200))
    whole = alignment.linked(a, ga, b, gb, 20, 9, 7)
    monkeypatch.setattr(alignment, "LINKS_AT_ONCE", 5)
    assert all((x == y).all() for x, y in zip(whole, alignment.linked(a, ga, b, gb, 20, 9, 7), strict=True))
    count = Counter((int(p) * 7 + int(q)) for p, g in zip(a, ga) for q, h in zip(b, gb) if g == h)
    assert dict(zip(*(x.tolist() for x in whole))) == count


def test_ranks_encode_every_code_point_as_the_file_says():
    t, ranks = Tokenizer.from_file(A), alignment.ByteLevel(A)
    t.encode_special_tokens = True
    points = [c for c in range(0x32000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 8):
        text = "".join(f" a{chr(c)}b 1{chr(c)}2 {chr(c)}." for c in points[i : i + 8])
        if ranks.encode(text).tolist() != t.encode(text, add_special_tokens=False).ids:
            raise AssertionError(points[i : i + 8])
