"""Personal data by candidate generation and gradient boosting, in DataFrame functions only.

Base spans come from four strict patterns with checks. Beside them, wider generators propose overlapping candidates: written-out
addresses, national phone numbers, numbers next to other numbers, short cards, long and shortened internet addresses. Boosted trees over
format and context features, compiled to column expressions, score each candidate; a calibrated threshold per
generator selects; where selected candidates overlap, the better score stays. Base spans always stay.

The trees are fitted on snippets made up in ``pii_examples``, run through the very same candidate and feature expressions.

Defined cases
    * null and empty texts have no spans; texts are read whole, and offsets count code points, end exclusive;
    * patterns take long runs without recursion; rows repeated or without id are read row by row;
    * a candidate that overlaps a base span is dropped; equal scores go to the earlier, then the longer candidate;
    * empty table: empty result; only the id and text columns are read, so other columns' names don't matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from navloom.llm.common import text_or_empty
from navloom.llm.pii_examples import examples
from navloom.llm.trees import Tree, boost, predict, sigmoid, tree_column

KINDS = ("email", "ip", "card", "phone")

# The four base patterns as Java reads them best: possessive, and starting only where a leftmost match can start.
_MAIL = r"[A-Za-z0-9._%+-]"
_CHAIN = r"(?<![0-9])(?<![0-9][\x20-])[0-9]"
BASE_PATTERNS = {
    "email": rf"(?:(?<!{_MAIL})|\G){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": _CHAIN + r"(?:[\x20-]?+[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?i:\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20)"
_DOT = r"(?i:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20|\.)"
#: Generator -> (kind, what a text must hold for it, pattern).
GENERATORS = {
    "written_mail": ("email", rf"{_AT}[A-Za-z0-9-]++{_DOT}[A-Za-z0-9]", rf"(?:(?<!{_MAIL})|\G){_MAIL}++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++"),
    "long_ip": ("ip", r":[0-9A-Fa-f]{1,4}:", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    "short_ip": ("ip", r"[0-9A-Fa-f]::[0-9A-Fa-f]", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}(?![0-9A-Za-z:])"),
    "grouped_card": ("card", r"[0-9]{4}[\x20-]?[0-9]{4}", r"(?<![0-9])[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}(?![0-9])"),
    "short_card": ("card", r"[0-9]{4}[\x20-]?[0-9]{4}", _CHAIN + r"(?:[\x20-]?+[0-9]){12,14}+(?![\x20-]?[0-9])"),
    "close_phone": ("phone", r"\+[0-9]", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}(?![0-9])"),
    "national_phone": ("phone", r"[0-9]{3}[\x20.-][0-9]{4}", r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
}
GENERATORS["trunk_phone"] = ("phone", r"0[0-9]{1,4}\)?[\x20./-][0-9]{3}", r"(?<![0-9+.])\(?0[0-9]{1,4}\)?[\x20./-][0-9]{3,4}(?:[\x20.-]?[0-9]{2,4}){1,2}(?![0-9])")
FEATURES = ("generator", "digits", "length", "luhn", "separators", "brackets", "plus", "leading", "different", "tail", "friendly", "hostile", "glued_before", "glued_after", "number_before", "number_after")
# Words that speak for personal data near a candidate, and words that speak for other numbers, in the four languages of the corpus.
_FRIENDLY = (
    r"(?:phone|tel|call|mobile|fax|whatsapp|mail|contact|write|reach|card|visa|amex|credit|pay|host|client|login|address|ip"
    r"|telefon|anruf|rufnummer|handy|kontakt|karte|rechner|téléphone|appelez|portable|courriel|carte|adresse|teléfono|llame|móvil|correo|tarjeta|servidor)(?![\p{L}])"
)
_HOSTILE = (
    r"(?:order|invoice|isbn|issn|version|ver|ref|serial|part|sku|model|batch|tracking|article|ticket|page|patent|meet|arrive|look|sold|shares|score"
    r"|bestellung|rechnung|artikel|seite|charge|commande|facture|référence|lot|pedido|factura|artículo|página|lote)(?![\p{L}])"
)
_CONTEXT = 28
#: Items of one block of a running state.
BLOCK = 64


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is worked out once however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], show: Callable[[Column, Column], Column], kind: str) -> Column:
    """``show(state, item)`` of each item, an array of ``kind``; ``step(state, item)`` is the next item's state.

    An array that grows inside an aggregation is copied at each step. So a first pass only keeps the state at the start
    of each block of items, and blocks are then shown one by one, from their state on: the cost is in proportion to the items.
    """
    empty = F.array().cast(f"array<{kind}>")

    def places(all_items: Column, number: Column) -> Column:
        return F.sequence(number * BLOCK, F.least((number + 1) * BLOCK, F.size(all_items)) - 1)

    def block_end(all_items: Column, at: Column, number: Column) -> Column:
        return F.aggregate(places(all_items, number), at, lambda s, i: step(s, F.get(all_items, i)))

    def shown(all_items: Column, at: Column, number: Column) -> Column:
        def add(state: Column, i: Column) -> Column:
            own = F.array(show(state["at"], F.get(all_items, i))).cast(f"array<{kind}>")
            return F.struct(step(state["at"], F.get(all_items, i)).alias("at"), F.concat(state["out"], own).alias("out"))

        return F.aggregate(places(all_items, number), F.struct(at.alias("at"), empty.alias("out")), add, lambda s: s["out"])

    def run(all_items: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / BLOCK).cast("int"))
        first = F.struct(zero.alias("at"), F.slice(F.array(zero), 1, 0).alias("starts"))
        starts = F.aggregate(numbers, first, lambda s, n: F.struct(block_end(all_items, s["at"], n).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")), lambda s: s["starts"])
        blocks = bound(starts, lambda found: F.flatten(F.transform(numbers, lambda n: shown(all_items, F.get(found, n), n))))
        return F.when(F.size(all_items) > 0, blocks).otherwise(empty)

    return bound(items, run)


_SPAN = "struct<start:int,end:int,text:string,before:string,after:string>"


def spans_of(text: Column, pattern: str, needs: str | None = None) -> Column:
    """array<struct<start, end, text, before, after>> of all matches, left to right, offsets in code points.

    ``before`` and ``after`` are the characters around a match, no further than to the match before and after it, those included.
    """
    no_text = F.array(F.lit(""))

    def pieces(cut: Column) -> Column:
        gaps, found = cut["gaps"], cut["found"]
        rest = F.slice(gaps, F.lit(2), F.size(gaps))
        zipped = F.arrays_zip(gaps.alias("gap"), found.alias("text"), F.concat(no_text, found).alias("last"), rest.alias("rest"), F.slice(found, F.lit(2), F.size(found) + 1).alias("next"))
        return F.slice(zipped, F.lit(1), F.size(found))

    def show(at: Column, p: Column) -> Column:
        start = at + F.char_length(p["gap"])
        before = F.right(F.concat(p["last"], p["gap"]), F.lit(_CONTEXT))
        after = F.left(F.concat(F.coalesce(p["rest"], F.lit("")), F.coalesce(p["next"], F.lit(""))), F.lit(_CONTEXT))
        return F.struct(start.alias("start"), (start + F.char_length(p["text"])).alias("end"), p["text"].alias("text"), before.alias("before"), after.alias("after"))

    cut = F.struct(F.split(text, pattern).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    found = running(bound(cut, pieces), F.lit(0), lambda at, p: at + F.char_length(p["gap"]) + F.char_length(p["text"]), show, _SPAN)
    return F.when(F.regexp_like(text, F.lit(needs or pattern)), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    size = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, size - i + 1, F.lit(1)).cast("int") * (2 - i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.when(size > 0, F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def _small_part(part: Column) -> Column:
    value = F.regexp_replace(part, "^0+(?=.)", "")
    return F.when(F.length(value) <= 3, value.cast("int") <= 255).otherwise(F.lit(False))


def _digit_count(low: int, high: int) -> Callable[[Column], Column]:
    return lambda s: F.length(digits_of(s["text"])).between(low, high)


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: F.forall(F.split(s["text"], r"\."), _small_part),
    "card": lambda s: _digit_count(16, 19)(s) & luhn_ok(digits_of(s["text"])),
    "phone": _digit_count(8, 15),
}


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> by kind as listed, then start; ``kind`` is the number in ``KINDS``."""
    def of_kind(number: int, kind: str) -> Column:
        sound = F.filter(spans_of(text, BASE_PATTERNS[kind]), CHECKS[kind])
        return F.transform(sound, lambda s: F.struct(F.lit(number).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return F.concat(*(of_kind(n, k) for n, k in enumerate(KINDS)))


def candidates(text: Column) -> Column:
    """array<struct<start, generator, end, kind, text, before, after>> that all generators propose."""
    def proposed(number: int, kind: str, needs: str, pattern: str) -> Column:
        def place(s: Column) -> Column:
            return F.struct(s["start"].alias("start"), F.lit(number).alias("generator"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"), *(s[n].alias(n) for n in ("text", "before", "after")))

        return F.transform(spans_of(text, pattern, needs), place)

    return F.concat(*(proposed(n, *g) for n, g in enumerate(GENERATORS.values())))


def features(c: Column) -> list[Column]:
    """The numbers that the trees read of one candidate, in the order of ``FEATURES``."""
    t = c["text"]
    digits = digits_of(t)
    near = F.lower(c["before"])
    yes = lambda condition: F.when(condition, 1.0).otherwise(0.0)
    return [
        c["generator"].cast("double"),
        F.length(digits).cast("double"),
        F.char_length(t).cast("double"),
        yes(luhn_ok(digits)),
        F.length(F.regexp_replace(t, r"[^\x20.:-]", "")).cast("double"),
        yes(F.regexp_like(t, F.lit(r"[\[(]"))),
        yes(F.startswith(t, F.lit("+"))),
        F.coalesce(F.substr(digits, F.lit(1), F.lit(1)).try_cast("double"), F.lit(-1.0)),
        F.size(F.array_distinct(F.split(digits, "(?<=.)(?=.)"))).cast("double"),
        F.char_length(F.regexp_extract(t, r"([A-Za-z]*)$", 1)).cast("double"),
        yes(F.regexp_like(near, F.lit(r"(?<![\p{L}])" + _FRIENDLY))),
        yes(F.regexp_like(near, F.lit(r"(?<![\p{L}])" + _HOSTILE))),
        yes(F.regexp_like(c["before"], F.lit(r"[A-Za-z0-9_/#$.-]$"))),
        yes(F.regexp_like(c["after"], F.lit(r"^(?:[A-Za-z_/%-]|[.,][0-9])"))),
        yes(F.regexp_like(c["before"], F.lit(r"[0-9][\x20.-]?$"))),
        yes(F.regexp_like(c["after"], F.lit(r"^[\x20.-]?[0-9]"))),
    ]


@dataclass(frozen=True)
class SpanModel:
    """Trees, Platt scaling (slope, offset) and the threshold of each generator on the scaled probability."""

    base: float
    trees: tuple[Tree, ...]
    slope: float
    offset: float
    thresholds: tuple[float, ...]

    def probability(self, values: list[Column]) -> Column:
        score = F.lit(self.base)
        for tree in self.trees:
            score = score + tree_column(tree, values)
        return 1 / (1 + F.exp(-(score * self.slope + self.offset)))


def _platt(score: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic fit by Newton steps, towards targets that are kept off 0 and 1."""
    up, down = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x, w = np.column_stack([score, np.ones(len(score))]), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        w = w - np.linalg.solve(hessian, x.T @ (p - target))
    return float(w[0]), float(w[1])


def fit_span_model(spark: SparkSession, precision: float = 0.995, trees: int = 24, depth: int = 3) -> SpanModel:
    """Fit on one half of the made-up snippets; scale and set thresholds on the other, for ``precision`` per generator."""
    snippets = examples()
    made = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(snippets)], "i int, text string").coalesce(1)
    rows = made.select("i", F.explode(candidates(F.col("text"))).alias("c")).select("i", "c.start", "c.end", *(f.alias(n) for n, f in zip(FEATURES, features(F.col("c")), strict=True))).collect()
    x = np.array([[r[n] for n in FEATURES] for r in rows])
    y = np.array([float((r["start"], r["end"]) in snippets[r["i"]][1]) for r in rows])
    fit = np.array([r["i"] % 2 == 0 for r in rows])
    base, forest = boost(x[fit], y[fit], trees=trees, depth=depth, rate=0.3, least=4)
    score = base + sum(predict(t, x) for t in forest)
    slope, offset = _platt(score[~fit], y[~fit])
    probability = sigmoid(score * slope + offset)
    thresholds = []
    for g in range(len(GENERATORS)):
        own = ~fit & (x[:, 0] == g)
        order = np.argsort(-probability[own])
        p, good = probability[own][order], np.cumsum(y[own][order])
        fine = np.flatnonzero(good >= precision * np.arange(1, len(p) + 1))
        thresholds.append(max(0.5, float(p[fine[-1]]) - 1e-9) if len(fine) else 2.0)
    return SpanModel(base, tuple(forest), slope, offset, tuple(thresholds))


_CANDIDATE = {"start": "int", "generator": "int", "end": "int", "kind": "int", "text": "string", "before": "string", "after": "string", "free": "boolean"}


def _apart_from(proposed: Column, base: Column) -> Column:
    """The candidates that overlap no base span: one pass over all spans in order of start, and one back."""
    kind = "struct<" + ",".join(f"{n}:{t}" for n, t in _CANDIDATE.items()) + ">"
    no_text = [F.lit("").alias(n) for n in ("text", "before", "after")]
    # Where starts are equal, base spans come first.
    marks = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(-1).alias("generator"), b["end"].alias("end"), b["kind"].alias("kind"), *no_text))

    def shown(x: Column, free: Column) -> Column:
        return F.struct(*(x[n].alias(n) for n in _CANDIDATE if n != "free"), free.alias("free"))

    there = running(
        F.sort_array(F.concat(marks, proposed)), F.lit(0),
        lambda covered, x: F.when(x["generator"] < 0, F.greatest(covered, x["end"])).otherwise(covered),
        lambda covered, x: shown(x, (x["generator"] >= 0) & (x["start"] >= covered)), kind,
    )
    back = running(
        F.reverse(there), F.lit(2**31 - 1),
        lambda nearest, x: F.when(x["generator"] < 0, x["start"]).otherwise(nearest),
        lambda nearest, x: shown(x, x["free"] & (x["end"] <= nearest)), kind,
    )
    return F.filter(back, lambda x: x["free"])


def _best_apart(above: Column) -> Column:
    """Of candidates that overlap, the better score stays, then the earlier, then the longer: array<struct<kind, start, end>>.

    Candidates that overlap one another, directly or over others, are a run; only members of a run are compared.
    """
    member = "struct<run:int,less:double,start:int,minus_end:int,kind:int>"

    def numbered(state: Column, x: Column) -> Column:
        run = state["run"] + F.when(x["start"] >= state["reach"], 1).otherwise(0)
        return F.struct(run.alias("run"), x["less"].alias("less"), x["start"].alias("start"), (-x["end"]).alias("minus_end"), x["kind"].alias("kind"))

    def reached(state: Column, x: Column) -> Column:
        run = state["run"] + F.when(x["start"] >= state["reach"], 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(state["reach"], x["end"]).alias("reach"))

    runs = running(F.sort_array(above), F.struct(F.lit(0).alias("run"), F.lit(0).alias("reach")), reached, numbered, member)
    none = F.array().cast("array<struct<start:int,end:int>>")

    def taken(state: Column, x: Column) -> Column:
        return (state["run"] == x["run"]) & F.exists(state["kept"], lambda k: (k["start"] < -x["minus_end"]) & (x["start"] < k["end"]))

    def step(state: Column, x: Column) -> Column:
        own = F.array(F.struct(x["start"].alias("start"), (-x["minus_end"]).alias("end")))
        kept = F.when(state["run"] != x["run"], own).when(taken(state, x), state["kept"]).otherwise(F.concat(state["kept"], own))
        return F.struct(x["run"].alias("run"), kept.alias("kept"))

    def show(state: Column, x: Column) -> Column:
        return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), (-x["minus_end"]).alias("end"), (~taken(state, x)).alias("stays"))

    shown = running(F.sort_array(runs), F.struct(F.lit(0).alias("run"), none.alias("kept")), step, show, "struct<kind:int,start:int,end:int,stays:boolean>")
    return F.transform(F.filter(shown, lambda x: x["stays"]), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def selected(model: SpanModel, proposed: Column, base: Column) -> Column:
    """array<struct<kind, start, end>> of the candidates above their threshold, apart from base spans and each other."""

    def rated(c: Column) -> Column:
        # Negative, so that the array's order puts the best score first.
        less = bound(F.array(*features(c)), lambda v: -model.probability([v[i] for i in range(len(FEATURES))]))
        return F.struct(c["start"].alias("start"), less.alias("less"), c["end"].alias("end"), c["kind"].alias("kind"), c["generator"].alias("generator"))

    thresholds = [F.lit(-t) for t in model.thresholds]

    def fine(r: Column) -> Column:
        limit = F.lit(float("-inf"))
        for g, t in enumerate(thresholds):
            limit = F.when(r["generator"] == g, t).otherwise(limit)
        return r["less"] <= limit

    above = F.filter(F.transform(_apart_from(proposed, base), rated), fine)
    return _best_apart(above)


def find_spans(docs: DataFrame, model: SpanModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, base and added: arrays of struct<kind, start, end>."""
    model = model or fit_span_model(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text"))).withColumn("proposed", candidates(F.col("text")))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    added = F.when(F.size("proposed") > 0, bound(F.struct("proposed", "base"), lambda s: selected(model, s["proposed"], s["base"]))).otherwise(none)
    return rows.select("doc_id", "text", "base", added.alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span, taken in order of start, replaced by its kind in square brackets; of overlapping spans the first counts."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(state: Column, s: Column) -> Column:
        shown = F.concat(state["out"], F.substr(text, state["at"] + 1, s["start"] - state["at"]), F.element_at(names, s["kind"] + 1))
        return F.when(s["start"] < state["at"], state).otherwise(F.struct(s["end"].alias("at"), shown.alias("out")))

    return F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.char_length(text))))


def redact(docs: DataFrame, model: SpanModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the redacted text."""
    found = find_spans(docs, model, id_col, text_col)
    return found.select("doc_id", redacted(F.col("text"), F.concat("base", "added")).alias("text"))
