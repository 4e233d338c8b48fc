"""Quality rules, personal data, embedding near-dedup."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from navloom.llm import embed_dedup, pii, quality


def test_rules_tell_junk_from_prose(spark, make_docs, words, no_docs):
    r = random.Random(9)
    prose = lambda: ". ".join(" ".join(r.choice(words) for _ in range(r.randint(5, 15))).capitalize() for _ in range(r.randint(2, 9)))
    junk = lambda: " | ".join(r.choice(words) + "!!!" * r.randint(0, 1) for _ in range(r.randint(10, 60)))
    texts = [prose() if i % 3 else junk() for i in range(400)] + [None, "", "one"]
    docs = make_docs(texts, extra=True)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(400)] + [(5, None, 0), (7, 9, 0)], "doc_id long, quality int, toxic int")
    rows = {x.doc_id: x for x in quality.score_documents(docs, labels).collect()}
    assert len(rows) == len(texts) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in rows.values())
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in rows.items())
    held = [(x.predicted, int(i % 3 != 0)) for i, x in rows.items() if x.held_out and i < 400]
    assert np.mean([a == b for a, b in held]) >= 0.97
    assert {x.doc_id for x in quality.good_documents(docs, labels).collect()} == {i for i, x in rows.items() if x.predicted}
    none = labels.limit(0)
    assert [x.score for x in quality.score_documents(docs.limit(5), none).collect()] == pytest.approx([0.5] * 5)
    assert quality.score_documents(no_docs, labels).count() == 0


def test_labels_of_held_out_rows_are_not_learned_from(spark, make_docs):
    docs = make_docs(["a b. c" if i % 2 else "!!! | | !" for i in range(100)])
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    one, two = (spark.createDataFrame([(i, int(flip) if held(i) else i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int") for flip in (False, True))
    a, b = ({r.doc_id: r.score for r in quality.score_documents(docs, x).collect()} for x in (one, two))
    assert a == b


def plain_statistics(text):
    """The statistics of one text by their plain definitions."""
    data = (text or "").encode()
    words = [w.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) for w in re.findall(rb"[^\x20\x09-\x0D]+", data)]
    share = lambda test: sum(map(test, data)) / len(data) if data else 0.0
    lines = data.count(b"\n")
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    sizes = [len(w) for w in words]
    n = len(words)
    return {
        "chars": len(data), "words": n, "word_size": np.mean(sizes) if n else 0, "short_words": np.mean([s <= 3 for s in sizes]) if n else 0,
        "different_words": len(set(words)) / n if n else 0, "commonest_word": max(map(words.count, words)) / n if n else 0,
        "same_as_before": np.mean([a == b for a, b in zip(words, words[1:])]) if n > 1 else 0, "repeated_runs": 1 - len(set(runs)) / len(runs) if runs else 0,
        "upper": share(lambda b: 65 <= b <= 90), "digit": share(lambda b: 48 <= b <= 57), "line_end": share(lambda b: b == 10), "stop": share(lambda b: b in b".,"),
        "bang": share(lambda b: b in b"!"), "bar": share(lambda b: b in b"|"), "beyond": share(lambda b: b > 127),
        "sign": share(lambda b: b < 128 and not chr(b).isalnum() and not chr(b).isspace() and chr(b) not in ".,!|"),
        "size_spread": np.std(sizes) if n else 0, "line_words": n / (1 + lines) if n else 0,
    }


def test_statistics_and_score_equal_their_plain_definitions(spark, make_docs, words):
    r = random.Random(12)
    texts = ["".join(r.choice([*words[:6], " ", "\n", ".", "!", "|", "é", "A", "7", "#", "\x00"]) for _ in range(r.randint(0, 80))) for _ in range(150)] + [None, "", "w " * 20_000, " \n "]
    docs = make_docs(texts, extra=True).unionAll(make_docs(texts[:5], extra=True))
    rows = quality.text_statistics(docs).collect()
    assert len(rows) == len(texts) + 5
    for row in rows:
        want = plain_statistics(texts[row.doc_id])
        assert {s: row[s] for s in quality.STATISTICS} == {s: pytest.approx(want[s], abs=1e-8) for s in quality.STATISTICS}
    model = quality.fit_rules(np.array([[row[s] for s in quality.STATISTICS] for row in rows]), np.array([float(len(texts[row.doc_id] or "") % 3 > 0) for row in rows]))
    assert model.rules
    scored = quality.text_statistics(docs).select("*", model.score([F.col(s) for s in quality.STATISTICS]).alias("score")).collect()
    for row in scored:
        total = model.intercept + sum(w for conditions, w in model.rules if all((row[quality.STATISTICS[f]] <= t) == at_most for f, at_most, t in conditions))
        assert row.score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-12)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(s)))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_match_brute_force(spark, make_docs):
    r = random.Random(6)
    bits = ["a.b@c-d.example.com", "x@y", "a@b.c_d@e.f", "1.2.3.4.5", "300.1.2.3", "0255.1.1.1", "4539 5787 6362 1486", "4539578763621486", "12-34", "+1 (269) 555-3296", "+12", " ", ",", "🙂", "é", "9" * 25, "..", "@", "call +44 20 7946 0958."]
    texts = ["".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randint(0, 12))) for _ in range(400)] + [None, "", "1 2 " * 30_000, "a" * 30_000 + "@", "7" * 20_000]
    for row in pii.find_spans(make_docs(texts, extra=True)).select("doc_id", pii.joined(F.col("base")).alias("base"), "base", "added").collect():
        assert row[1] == ",".join(brute(texts[row.doc_id] or ""))
        for a in row.added:
            assert all(a.end <= b.start or b.end <= a.start for b in row[2])


def test_method_adds_what_the_base_misses(spark, make_docs, no_docs):
    texts = ["call 212-555-0147 now", "write to anna.ben [at] example [dot] com", "+1 (269) 555-3296 4539578763621486", "order 212-555-0147", "the river under green stone at home. Then"]
    model = pii.fit_span_model(spark)
    rows = {r.doc_id: r for r in pii.find_spans(make_docs(texts), model).collect()}
    spans = {i: {(pii.KINDS[s.kind], texts[i][s.start : s.end]) for s in r.added} for i, r in rows.items()}
    assert spans[0] == {("phone", "212-555-0147")} and spans[1] == {("email", "anna.ben [at] example [dot] com")}
    assert spans[2] == {("phone", "+1 (269) 555-3296"), ("card", "4539578763621486")} and spans[3] == spans[4] == set()
    assert {r.doc_id: r.text for r in pii.redact(make_docs(texts), model).collect()}[2] == "[PHONE] [CARD]"
    assert pii.find_spans(no_docs, model).count() == 0


PROSE = {"en": "the river was green and the morning paper lay under a window".split(), "de": "der Fluß war grün und die Zeitung lag unter einem Fenster".split(), "fr": "la rivière était verte et le journal restait sous une fenêtre".split(), "es": "el río era verde y el periódico quedaba bajo una ventana".split()}
CALLS = {"en": ("call", "order"), "de": ("Telefon", "Bestellung"), "fr": ("téléphone", "commande"), "es": ("teléfono", "pedido")}


def planted(r, lang):
    """(text, spans that are personal data) in one language; half hold a number that is none."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    yes, no = CALLS[lang]
    lead, body, kind = r.choice([
        (yes, f"{d(3)}-{d(3)}-{d(4)}", "phone"), (yes, f"0{r.randint(100, 999)} {d(3)} {d(4)}", "phone"), (yes, f"(0{r.randint(10, 99)}) {d(4)} {d(4)}", "phone"),
        ("mail", f"ana.{r.choice(PROSE['en'])} [AT] example [DOT] org", "email"), ("host", f"2001:db8:{d(3)}::{d(2)}", "ip"), (no, f"{d(3)}-{d(3)}-{d(4)}", None), (no, f"0{r.randint(100, 999)} {d(3)} {d(4)}", None), ("", "add::bad", None),
    ])
    words = lambda n: " ".join(r.choice(PROSE[lang]) for _ in range(n))
    head = f"{words(r.randint(2, 9))} {lead} ".replace("  ", " ")
    return head + body + " " + words(r.randint(2, 9)), [(kind, len(head), len(head) + len(body))] if kind else []


def test_precision_and_recall_on_planted_data_of_four_languages(spark, make_docs):
    r = random.Random(31)
    made = [(lang, *planted(r, lang)) for lang in PROSE for _ in range(150)]
    hit, found, wanted = {}, {}, {}
    for row in pii.find_spans(make_docs([t for _, t, _ in made])).collect():
        lang, _, want = made[row.doc_id]
        got = {(pii.KINDS[s.kind], s.start, s.end) for s in [*row.base, *row.added]}
        for key in ([lang], *([k] for k in pii.KINDS)):
            k = key[0]
            mine = lambda spans: {s for s in spans if k == lang or s[0] == k}  # noqa: B023, E731
            hit[k], found[k], wanted[k] = hit.get(k, 0) + len(mine(got) & mine(set(want))), found.get(k, 0) + len(mine(got)), wanted.get(k, 0) + len(mine(set(want)))
    for k in (*PROSE, "phone", "email", "ip"):
        assert hit[k] >= 0.9 * wanted[k] > 0, ("recall", k, hit, wanted)
        assert hit[k] >= 0.95 * found[k], ("precision", k, hit, found)


def test_added_spans_equal_plain_selection(spark, make_docs):
    """Every candidate's own score, then: apart from base spans, above its threshold, best first."""
    r, model = random.Random(8), pii.fit_span_model(spark)
    bits = ["212-555-0147", "call 212-555-0147", "030 123 4567", "4539 5787 6362 1486", "1234 5678 9012 345", "+1 (269) 555-3296", "+49 30 1234 5678 9012", "a.b [at] c [dot] de", "fe80::1:2", "tel", "order", " ", "x", "7"]
    texts = [" ".join(r.choice(bits) for _ in range(r.randint(0, 200))) for _ in range(40)] + [None]
    docs = make_docs(texts).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    score = lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["generator"].alias("generator"), pii.bound(F.array(*pii.features(c)), lambda v: model.probability([v[i] for i in range(len(pii.FEATURES))])).alias("p"))
    rated = {x.doc_id: x.c for x in docs.select("doc_id", F.transform(pii.candidates(F.col("text")), score).alias("c")).collect()}
    some = 0
    for row in pii.find_spans(docs, model).collect():
        kept = []
        free = [c for c in rated[row.doc_id] if c.p >= model.thresholds[c.generator] and all(c.end <= b.start or b.end <= c.start for b in row.base)]
        for c in sorted(free, key=lambda c: (-c.p, c.start, -c.end)):
            if all(c.end <= k.start or k.end <= c.start for k in kept):
                kept.append(c)
        assert sorted((s.kind, s.start, s.end) for s in row.added) == sorted((c.kind, c.start, c.end) for c in kept)
        some += len(kept)
    assert some > 50


def test_cost_grows_with_the_text(spark, make_docs):
    """5 MB with some 50,000 spans in one text."""
    line = "call 212-555-0147 or write a.b@c.de and so on " + "the river was green and wide " * 6 + "10.1.2.3\n"
    n = 5_000_000 // len(line)
    model, start = pii.fit_span_model(spark), time.monotonic()
    row = pii.find_spans(make_docs([line * n]), model).select(F.size("base").alias("b"), F.size("added").alias("a")).first()
    assert (row.b, row.a) == (2 * n, n) and 3 * n > 50_000
    assert time.monotonic() - start < 60


def test_near_duplicates_match_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 16))
    x = np.concatenate([base, base[:30] + r.normal(size=(30, 16)) * 0.25, base[:1].repeat(25, 0) + r.normal(size=(25, 16)) * 0.2, base[:5]]).astype(np.float32)
    labels = [int(i) for i in r.integers(0, 2, len(x))]
    rows = [(i, [float(v) for v in x[i]], labels[i]) for i in range(len(x))]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, [None] + [1.0] * 15, 1), (904, rows[0][1], None), (905, [float("inf")] * 16, 1), (906, rows[0][1][:8], labels[0]), (907, [], 0), (None, rows[3][1], labels[3])]
    got = [tuple(v) for v in embed_dedup.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")).collect()]
    by = {v[0]: v for v in got}
    assert len(got) == len(rows) + len(odd)
    n = len(x)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = (unit @ unit.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None])
    label = list(range(n))
    for _ in range(n):
        label = [min(label[j] for j in range(n) if link[i, j]) for i in range(n)]
    copies = link[3]  # the row without id is one more link for those of vector 3
    for i in range(n):
        assert by[i][1:] == (int(link[i].sum()) - 1 + int(copies[i]), label[i], label[i] == i)
    for i, *_ in odd[:-1]:
        assert by[i][1:] == (0, i, True)
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_multi_sequence_visits_nearest_cells_first():
    r = np.random.default_rng(0)
    a, b = r.random(9), r.random(7)
    want = sorted(range(63), key=lambda c: a[c // 7] + b[c % 7])
    assert embed_dedup.multi_sequence(a, b, 63) == want and embed_dedup.multi_sequence(a, b, 5) == want[:5]


def test_ranks_are_places_in_the_traversal():
    r = np.random.default_rng(4)
    x = embed_dedup.unit(r.normal(size=(300, 12)))
    index = embed_dedup.MultiIndex(embed_dedup.fit_codes(x[:, :6], 7, 1), embed_dedup.fit_codes(x[:, 6:], 7, 2), 0)
    cells = index.cells(x[::-1])
    want = [order.index(c) for order, c in zip(index.order(x, 49), cells, strict=True)]
    assert index.ranks(x, cells).tolist() == want


def test_near_duplicates_on_a_larger_grid_match_brute_force(spark):
    """Few of many cells are visited; all links of 6,000 vectors are compared."""
    r = np.random.default_rng(8)
    base = r.normal(size=(3000, 24))
    x = np.concatenate([base, base + r.normal(size=base.shape) * r.choice([0.1, 0.3, 0.4], size=(3000, 1))])
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(len(x))]
    unit = embed_dedup.unit(x)
    want = (unit @ unit.T >= 0.93).sum(1) - 1
    got = {v.vec_id: v.n_links for v in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.99 * want.sum() > 1000


def test_recall_on_hard_links():
    r = np.random.default_rng(5)
    x = embed_dedup.unit(r.normal(size=(3000, 32)))
    index = embed_dedup.MultiIndex.fit(x, 8, 0.93, 0.98)
    away = r.normal(size=x.shape)
    away -= (away * x).sum(1)[:, None] * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * embed_dedup.unit(away)
    hits = [t in a or s in b for a, b, t, s in zip(index.order(x, index.visits), index.order(y, index.visits), index.cells(y), index.cells(x), strict=True)]
    assert np.mean(hits) >= 0.95 and index.visits < 64
