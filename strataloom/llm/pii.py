r"""PII by candidate gradient boosting, in DataFrame functions only.

Base rules find well-formed spans of four kinds, leftmost and non-overlapping per kind, and check them (see BASE). High-recall
generators propose further spans, which may overlap: every number of groups that a phone number could have, cards inside a longer run
of digits, defanged hosts, spelled-out addresses, and strings that may be credentials. Each proposal is normalised ("[at]" is "@", a
country code goes), described by its format and by the characters and words around it, and scored by boosted trees. A threshold per
kind, calibrated by odds of rows that the trees behind them have not seen, selects what is redacted. Base spans always stay; a selected span that
overlaps a base span, or a better selected one, goes.

The trees learn from the corpus itself, all of it. Every row is labelled by the base rules: a proposal that equals a base
span is one; one that lies inside a match that the rules dropped whole, or that only lacks the sign the rules ask for, teaches nothing;
all others are none. What the rules ask for literally (the plus of a phone number, the @ of an address) isn't a feature, so that format
and context must tell. Vectors drawn evenly over the range of the features are negatives too, so that unseen formats are left alone. Credentials have no base rule: they are labelled by the words before them and learned by their format alone.
A native query counts the proposals of all whole texts by feature vector; fitting reads all counts, which the ranges of the features bound
whatever the corpus (packed to a long each). Trees are grown on all counts; each half of the rows by hash calibrates the trees
grown on the other one, and both together give the threshold. The fitted trees are a column expression, so scoring needs no Python.

Positions come from the lengths of matches and of the text between them, in code points, summed in blocks, so that a text with very
many matches takes linear time. Patterns are possessive or bounded and anchored at the start of a run.

Defined results: null text counts as empty and has no spans. A kind without a labelled positive gets no added span, so a table too small
to learn from has base spans alone. Very long texts are searched whole. Rows are independent, so they may repeat; extra columns pass
through (columns called base, spans, secrets or redacted are replaced); an empty table gives an empty one.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound

KINDS = ["email", "ip", "card", "phone"]
#: What the method finds beside them.
SECRET = "secret"
#: Kind: (what a text must hold, linear form of the base pattern).
BASE = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Generators: (kind, what a text must match, pattern, whether a proposal lacks the sign that the base rule asks for).
GENERATORS = [
    ("email", "@", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}+", False),
    ("email", r"(?i)[(\[ ]at[)\] ]", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]| at ) ?[a-z0-9-]{1,63}+(?:(?: ?(?:\(dot\)|\[dot\])| dot) ?[a-z0-9-]{1,63}+|\.[a-z0-9-]{1,63}+){1,4}+", True),
    ("ip", r"[0-9]\[?\.", r"(?<![0-9])[0-9]{1,3}+(?:\[?\.\]?[0-9]{1,3}+){3}+(?![0-9])", False),
    ("card", "[0-9]{13}", r"(?<![0-9])[0-9]{13,19}+(?![0-9])", False),
    ("card", "[0-9]{4}[ ./-][0-9]{4}", r"(?<![0-9])[0-9]{4}(?:[ ./-][0-9]{4}){2}[ ./-][0-9]{1,7}+(?![0-9])", False),
    ("card", "[0-9]{4}[ ./-][0-9]{6}", r"(?<![0-9])[0-9]{4}[ ./-][0-9]{6}[ ./-][0-9]{5}(?![0-9])", False),
    *(("phone", r"\+[0-9]", rf"\+[0-9]{{1,3}}(?:[ .()-]{{1,3}}[0-9]{{2,8}}){{{k}}}(?![0-9])", False) for k in (2, 3, 4)),
    *(("phone", r"[0-9][ .)-]{1,2}[0-9]", rf"(?<![0-9A-Za-z+.])\(?[0-9]{{2,4}}\)?(?:[ .-]{{1,2}}[0-9]{{2,8}}){{{k}}}(?![0-9A-Za-z])", True) for k in (2, 3)),
    (SECRET, "[A-Za-z0-9_+/=-]{16}", r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,256}+(?![A-Za-z0-9_+/=-])", False),
]
CONTEXT = 24
#: Context words by kind.
WORDS = {
    "email": "mail|contact|write|reach|correo|courriel|adresse|kontakt",
    "ip": "ip|host|server|address|login|serveur|servidor",
    "card": "card|visa|master|amex|pay|credit|carte|tarjeta|karte",
    "phone": "phone|tel|call|fax|mobile|whatsapp|sms|appel|llama|ruf|handy",
}
#: Words that say that a credential follows, and words that say that a number is no personal one.
ASSIGNED = r"(?i)(?:token|secret|passw(?:or)?d|api.?key|access.?key|auth|bearer|credential)[\"' ]*[=:]?[\"' ]*$"
OTHER = r"(?:version|order|invoice|no\.|page|isbn|date|vol|section|article|total|id|ref)\W*$"
TOP = r"(?i)\.(?:com|org|net|edu|gov|mil|int|io|info|biz|de|fr|es|uk|it|eu|us|ca|ch|at|nl)$"
FEATURE_BITS = 5  # a feature is less than 2**5, so that a vector fits into a long
ROUNDS, RATE, DEPTH, PRECISION, REFERENCE = 24, 0.4, 3, 0.95, 2_000
BLOCK = 256
_SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"


def scan(items: Column, zero: Column, step: Callable, kind: str) -> Column:
    """The array of what step(state, item) -> (state, value) gives along an array, which must be bound. It grows by blocks, as adding to
    an array copies it."""
    none = F.array().cast(f"array<{kind}>")

    def one(a: Column, x: Column) -> Column:
        state, value = step(a["s"], x)
        return F.struct(state.alias("s"), F.concat(a["out"], F.array(value)).alias("out"))

    def block(a: Column, b: Column) -> Column:
        own = F.aggregate(F.slice(items, b * BLOCK + 1, F.lit(BLOCK)), F.struct(a["s"].alias("s"), none.alias("out")), one)
        return bound(own, lambda o: F.struct(o["s"].alias("s"), F.concat(a["out"], F.array(o["out"])).alias("out")))

    blocks = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    start = F.struct(zero.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.flatten(F.aggregate(blocks, start, block, lambda a: a["out"]))


def found(text: Column, needs: str, pattern: str, regex: bool = False) -> Column:
    """Array of (start, end, value, before, after) of all matches: what stands between a match and the ones beside it, up to CONTEXT
    characters before and one after."""
    may = text.rlike(needs) if regex or needs.startswith("[") else F.contains(text, F.lit(needs))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        end = start + F.length(x["value"])
        return end, F.struct(start.alias("start"), end.alias("end"), *[x[n].alias(n) for n in ("value", "before", "after")])

    def pair(values: Column, gaps: Column) -> Column:
        left = F.zip_with(values, F.slice(gaps, F.lit(1), F.size(values)), lambda v, g: F.struct(F.length(g).alias("gap"), v.alias("value"), F.right(g, F.lit(CONTEXT)).alias("before")))
        return F.zip_with(left, F.slice(gaps, F.lit(2), F.size(values)), lambda x, g: F.struct(x["gap"].alias("gap"), x["value"].alias("value"), x["before"].alias("before"), F.left(g, F.lit(1)).alias("after")))

    def place(values: Column) -> Column:
        pairs = bound(F.split(text, pattern, -1), lambda gaps: pair(values, gaps))
        placed = bound(pairs, lambda p: scan(p, F.lit(0), step, _SPAN))
        return F.when(F.size(values) > 0, placed).otherwise(F.array().cast(f"array<{_SPAN}>"))

    return F.when(may, bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def small_parts(value: Column) -> Column:
    """Whether all numbers in a dotted value are at most 255."""
    bare = F.transform(F.split(value, r"\[?\.\]?"), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(bare, lambda p: (F.length(p) <= 3) & (F.expr("0") <= p.try_cast("int")) & (p.try_cast("int") <= 255))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return small_parts(value)
    count = F.length(digits_of(value))
    if kind == "card":
        return F.when(count.between(13, 19), luhn(digits_of(value))).otherwise(False)
    return count.between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (kind number, start, end), by kind and start."""

    def of(number: int, kind: str) -> Column:
        valid = F.filter(found(text, *BASE[kind]), lambda x: _valid(kind, x["value"]))
        return F.transform(valid, lambda x: _span(F.lit(number), x))

    return F.concat(*(of(i, k) for i, k in enumerate(KINDS)))


def _span(kind: Column, x: Column) -> Column:
    return F.struct(kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"))


def normal(kind: str, value: Column) -> Column:
    """A proposal without what sets its way of writing apart from a base span's."""
    if kind == "email":
        value = F.regexp_replace(value, r"(?i) ?(?:\(at\)|\[at\]| at ) ?", "@")
        return F.regexp_replace(value, r"(?i)(?: ?(?:\(dot\)|\[dot\])| dot) ?", ".")
    if kind == "ip":
        return F.regexp_replace(value, r"\[?\.\]?", ".")
    return F.regexp_replace(value, r"^\+[0-9]{1,3}[ .-]*", "") if kind == "phone" else value


def _edge(c: Column) -> Column:
    """What a neighbouring character is: 0 a boundary, 1 a digit, 2 a letter, 3 a sign that joins."""
    return F.when(c.rlike("[0-9]"), 1).when(c.rlike(r"\p{L}"), 2).when(c.rlike(r"[@_/+\\&=#-]"), 3).otherwise(0)


def features(kind: str, before: Column, value: Column, after: Column) -> list[Column]:
    """Small integers: format of the normalised value, then context."""
    runs = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    run = lambda i: F.least(F.coalesce(F.length(F.try_element_at(runs, F.lit(i))), F.lit(0)), F.lit(9))
    digits = digits_of(value)
    count, groups = F.least(F.length(digits), F.lit(20)), F.least(F.size(runs), F.lit(7))
    edges = [_edge(F.substring(before, -1, 1)), _edge(after)]
    if kind == SECRET:
        size, part = F.length(value), lambda pattern: F.floor(F.length(F.regexp_replace(value, pattern, "")) * 3 / F.length(value)).cast("int")
        return [F.least(F.floor(size / 8).cast("int"), F.lit(9)), part("[^0-9]"), part("[^A-Z]"), part("[^a-z]"), value.rlike("^[0-9A-Fa-f]+$").cast("int"), value.rlike("[a-zA-Z]{6}").cast("int")]
    lowered = F.lower(before)
    context = [lowered.rlike(rf"\b(?:{WORDS[kind]})").cast("int"), lowered.rlike(OTHER).cast("int"), *edges]
    if kind == "email":
        return [value.rlike(TOP).cast("int"), F.least(F.size(F.split(value, r"\.")), F.lit(6)), F.least(F.instr(value, "@"), F.lit(9)), *context]
    if kind == "ip":
        return [small_parts(value).cast("int"), groups, F.size(F.filter(runs, lambda r: F.length(r) == 3)), *context]
    if kind == "card":
        return [F.coalesce(F.when(count.between(13, 19), luhn(digits)), F.lit(False)).cast("int"), count, groups, value.rlike("[./]").cast("int"), *context]
    return [count, groups, run(-1), run(-2), run(1), value.rlike(r"^(?:19|20)[0-9]{2}[ ./-][01]?[0-9][ ./-][0-3]?[0-9]").cast("int"), value.rlike("^[(]").cast("int"), *context]


def _proposals(kind: str, needs: str, pattern: str) -> Column:
    """(start, end, x) of a generator's matches in __text, x: the feature vector."""

    def describe(m: Column) -> Column:
        vector = bound(normal(kind, m["value"]), lambda v: F.array(*[f.cast("int") for f in features(kind, m["before"], v, m["after"])]))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), vector.alias("x"), m["before"].rlike(ASSIGNED).alias("assigned"))

    return F.transform(found(F.col("__text"), needs, pattern, regex=True), describe)


# --- Labels from the corpus -----------------------------------------------------------------------------------------------------
_MARK = "struct<start:int,late:boolean,end:int,valid:boolean,masked:boolean,x:array<int>,next:int>"
_LABELLED = "struct<label:int,x:array<int>>"


def _labels(raw: Column, proposals: Column, masked: bool) -> Column:
    """(label, x) of proposals by the raw matches of the base rule, which don't overlap: 1 for one that is a valid match, null for one inside
    an invalid match or, where masked, over any. The match that began last tells, and where masked the next one: two sweeps, so that a
    text with very many takes linear time after sorting."""
    mark = lambda m, late, valid, lacks, x: F.struct(m["start"].alias("start"), F.lit(late).alias("late"), m["end"].alias("end"), valid.alias("valid"), lacks.alias("masked"), x.alias("x"), F.lit(2**31 - 1).alias("next")).cast(_MARK)
    no, none = F.lit(None).cast("boolean"), F.lit(None).cast("array<int>")
    marks = F.array_sort(F.concat(F.transform(raw, lambda r: mark(r, False, r["valid"], no, none)), F.transform(proposals, lambda m: mark(m, True, no, m["masked"], m["x"]))))

    def back(following: Column, m: Column) -> tuple[Column, Column]:
        own = F.struct(*[m[c].alias(c) for c in ("start", "late", "end", "valid", "masked", "x")], following.alias("next"))
        return F.when(m["late"], following).otherwise(m["start"]), own.cast(_MARK)

    def step(last: Column, m: Column) -> tuple[Column, Column]:
        same = (last["start"] == m["start"]) & (last["end"] == m["end"])
        inside = ~last["valid"] & (m["end"] <= last["end"]) & ~same
        unsure = inside | m["masked"] & ((last["end"] > m["start"]) | (m["next"] < m["end"]))
        label = F.when(last["valid"] & same, 1).when(~unsure, 0)
        return F.when(m["late"], last).otherwise(m).cast(_MARK), F.struct(F.when(m["late"], label).alias("label"), m["x"].alias("x")).cast(_LABELLED)

    before = F.struct(F.lit(-1).alias("start"), F.lit(False).alias("late"), F.lit(-1).alias("end"), F.lit(False).alias("valid"), no.alias("masked"), none.alias("x"), F.lit(0).alias("next")).cast(_MARK)
    whole = bound(marks, lambda w: F.reverse(bound(F.reverse(w), lambda r: scan(r, F.lit(2**31 - 1), back, _MARK)))) if masked else marks
    labelled = F.filter(bound(whole, lambda w: scan(w, before, step, _LABELLED)), lambda e: e["label"].isNotNull())
    return F.when(F.size(proposals) > 0, labelled).otherwise(F.array().cast(f"array<{_LABELLED}>"))


def examples(docs: DataFrame, text: str = "text") -> DataFrame:
    """(half, kind, label, x) of all proposals in the whole texts of all docs; half, by the text's hash, tells rows to calibrate the trees of the other half."""
    docs = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))

    def labelled(kind: str) -> Column:
        given = lambda e: F.struct(F.lit(kind).alias("kind"), e["label"].alias("label"), e["x"].alias("x"))
        own = [g for g in GENERATORS if g[0] == kind]
        if kind == SECRET:
            return F.concat(*(F.transform(_proposals(*g[:3]), lambda m: given({"label": m["assigned"].cast("int"), "x": m["x"]})) for g in own))
        raw = F.transform(found(F.col("__text"), *BASE[kind]), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), _valid(kind, m["value"]).alias("valid")))
        of = lambda g: F.transform(_proposals(*g[:3]), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(g[3]).alias("masked"), m["x"].alias("x")))
        labels = bound(F.concat(*map(of, own)), lambda p: F.when(F.size(p) > 0, bound(raw, lambda r: _labels(r, p, any(g[3] for g in own)))).otherwise(F.array().cast(f"array<{_LABELLED}>")))
        return F.transform(labels, given)

    half = (F.xxhash64("__text", F.lit("pii")).bitwiseAND(1 << 40) > 0).cast("int").alias("half")
    return docs.select(half, F.explode(F.concat(*map(labelled, [*KINDS, SECRET]))).alias("e")).select("half", "e.*")


# --- Boosted trees --------------------------------------------------------------------------------------------------------------
class Trees:
    """Boosted trees over integer features: a list of (feature, cut, low, high), where low and high are trees or numbers."""

    def __init__(self, trees: list, threshold: float, width: int):
        self.trees, self.threshold, self.width = trees, threshold, width

    @staticmethod
    def value(tree, x: Sequence[int]) -> float:
        while not isinstance(tree, float):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    def odds(self, x: Sequence[int]) -> float:
        return sum(self.value(t, x) for t in self.trees)

    def column(self, x: list[Column]) -> Column:
        def of(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            return F.when(x[tree[0]] <= tree[1], of(tree[2])).otherwise(of(tree[3]))

        return reduce(lambda a, b: a + b, map(of, self.trees), F.lit(0.0))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """Newton leaf values, splits by gain from sums by feature value. x: a row of small integers an example; g, h: gradient, hessian."""
    whole_g, whole_h, best = g.sum(), h.sum(), None
    for f in range(x.shape[1]) if depth else ():
        gl, hl = (np.cumsum(np.bincount(x[:, f], v))[:-1] for v in (g, h))
        gain = gl * gl / (hl + 1) + (whole_g - gl) ** 2 / (whole_h - hl + 1) - whole_g * whole_g / (whole_h + 1)
        if len(gain) and (best is None or gain.max() > best[0] + 1e-9) and gain.max() > 1e-6:
            best = gain.max(), f, int(gain.argmax())
    if not best:
        return float(RATE * whole_g / (whole_h + 1))
    _, f, cut = best
    low = x[:, f] <= cut
    return f, cut, _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1)


def _values(tree, x: np.ndarray) -> np.ndarray:
    """A tree's value of each row of x."""
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    out, left = np.empty(len(x)), x[:, f] <= cut
    out[left], out[~left] = _values(low, x[left]), _values(high, x[~left])
    return out


def _odds(trees: list, x: np.ndarray) -> np.ndarray:
    return sum((_values(t, x) for t in trees), np.zeros(len(x)))


def _boosted(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list:
    trees, score = [], np.zeros(len(x))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        trees.append(_grow(x, weight * (label - p), weight * p * (1 - p), DEPTH))
        score += _values(trees[-1], x)
    return trees


def reference(vectors: np.ndarray, positives: np.ndarray, n: int = REFERENCE) -> np.ndarray:
    """Vectors that the corpus doesn't show, as negatives: by turns, all features drawn evenly from their range and a little past it, and a
    positive with one feature redrawn. So the trees bound the positives on all sides, not only against the negatives at hand. Words
    beside a proposal are taken as they are in the corpus: their absence there says nothing. vectors, positives: distinct rows."""
    drawn, tops = random.Random(1), [1 if most <= 1 else most + 3 for most in vectors.max(axis=0).tolist()]
    words = {len(tops) - 4, len(tops) - 3} if len(tops) > 6 else set()
    free = [f for f in range(len(tops)) if f not in words]
    out = []
    for i in range(n):
        pool = positives if i % 4 < 2 else vectors
        x = pool[drawn.randrange(len(pool))].tolist()
        for f in [drawn.choice(free)] if i % 4 < 2 else free:
            x[f] = drawn.randrange(tops[f] + 1)
        out.append(x)
    out = np.array(out, np.int64)
    return out[~np.isin(_packed(out), _packed(vectors))]


def _packed(x: np.ndarray) -> np.ndarray:
    return (x << (FEATURE_BITS * np.arange(x.shape[1]))).sum(axis=1)


def fit(x: np.ndarray, half: np.ndarray, label: np.ndarray, n: np.ndarray) -> Trees:
    """A row of x, its half, label and number for each count. Trees grow on all rows. The threshold is the least odds of positives
    that keep PRECISION, and a majority among equal odds, where the odds of each half come from trees grown on the other. Reference vectors,
    weighing as much as the positives beside them, are negatives throughout."""
    drawn = reference(np.unique(x, axis=0), np.unique(x[label == 1], axis=0))
    positives = [n[(half == h) & (label == 1)].sum() for h in (0, 1)]

    def rows(own: np.ndarray, more: np.ndarray, weight: float) -> tuple[np.ndarray, ...]:
        return np.concatenate([x[own], more]), np.concatenate([label[own], np.zeros(len(more))]), np.concatenate([n[own], np.full(len(more), weight / max(1, len(more)))])

    halves = [rows(half == h, drawn[h::2], positives[h]) for h in (0, 1)]
    odds = [_odds(_boosted(*halves[1 - h]), halves[h][0]) for h in (0, 1)]
    values, at = np.unique(np.round(np.concatenate(odds), 9), return_inverse=True)
    truth, weight = (np.concatenate([halves[h][k] for h in (0, 1)]) for k in (1, 2))
    yes, no = np.bincount(at, weight * truth, len(values)), np.bincount(at, weight * (1 - truth), len(values))
    right, wrong = (np.cumsum(v[::-1])[::-1] for v in (yes, no))
    fine = np.flatnonzero((yes > no) & (values > 0) & (right >= PRECISION * (right + wrong)))
    threshold = float(values[fine[0]]) - 1e-6 if len(fine) else math.inf
    return Trees(_boosted(*rows(np.ones(len(x), bool), drawn, sum(positives))), threshold, x.shape[1])


def train(docs: DataFrame, text: str = "text") -> dict[str, Trees]:
    """Trees by kind, from all rows of the corpus that they are to judge. A kind without positives in both halves has none."""
    packed = F.aggregate("x", F.lit(0).cast("long"), lambda a, f: F.call_function("shiftleft", a, F.lit(FEATURE_BITS)) + f)
    counted = examples(docs, text).select("half", "kind", "label", F.size("x").alias("width"), packed.alias("x")).groupBy("half", "kind", "label", "width", "x").agg(F.count("*").alias("n"))
    table, out = counted.toArrow(), {}
    kinds, columns = np.array(table["kind"].to_pylist(), object), {c: table[c].to_numpy().astype(np.int64) for c in ("half", "label", "width", "x", "n")}
    for kind in sorted(set(kinds)):
        half, label, width, x, n = (v[kinds == kind] for v in columns.values())
        order = np.lexsort([x, label, half])
        half, label, x, n = half[order], label[order], x[order], n[order].astype(float)
        if {*half[label == 1].tolist()} == {0, 1}:
            bits = FEATURE_BITS * np.arange(width[0])[::-1]
            out[kind] = fit(x[:, None] >> bits & (1 << FEATURE_BITS) - 1, half, label.astype(float), n)
    return out


def _selected(number: int, kind: str, needs: str, pattern: str, trees: Trees) -> Column:
    """(kind, start, end, odds) of a generator's proposals above the threshold."""

    def odds(m: Column) -> Column:
        score = trees.column([m["x"][i] for i in range(trees.width)])
        return F.struct(F.lit(number).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), score.alias("odds"))

    return F.filter(F.transform(_proposals(kind, needs, pattern), odds), lambda m: m["odds"] > trees.threshold)


_FOUND = "struct<kind:int,start:int,end:int,odds:double>"


def _apart(base: Column, more: Column) -> Column:
    """The selected spans that overlap no base span; of selected ones that overlap, the best stays (then the longest, then the first),
    from left to right. A sweep from the right drops what reaches into the next base span, one from the left the rest."""
    none = F.lit(None).cast(_FOUND)
    as_found = F.transform(base, lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"), F.lit(None).cast("double").alias("odds")))
    order = lambda x: F.struct(x["start"].alias("start"), x["odds"].isNotNull().alias("late"), x.alias("x"))
    whole = F.transform(F.array_sort(F.transform(F.concat(as_found, more, F.array(F.struct(F.lit(-1).alias("kind"), F.lit(2**31 - 1).alias("start"), F.lit(2**31 - 1).alias("end"), F.lit(None).cast("double").alias("odds")))), order)), lambda o: o["x"])

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        held, covered = state["held"], state["covered"]
        is_base = x["odds"].isNull()
        apart = held.isNull() | (held["end"] <= x["start"])
        better = (x["odds"] > held["odds"]) | (x["odds"] == held["odds"]) & (x["end"] - x["start"] > held["end"] - held["start"])
        hit = x["start"] < covered
        after = F.when(is_base | (apart & ~hit), F.when(is_base, none).otherwise(x)).otherwise(F.when(hit | ~better, held).otherwise(x))
        given = F.when(apart & (is_base | ~hit), held).otherwise(none)
        return F.struct(after.cast(_FOUND).alias("held"), F.when(is_base, F.greatest(covered, x["end"])).otherwise(covered).alias("covered")), given.cast(_FOUND)

    def back(next_base: Column, x: Column) -> tuple[Column, Column]:
        is_base = x["odds"].isNull()
        return F.when(is_base, x["start"]).otherwise(next_base), F.when(is_base | (x["end"] <= next_base), x).otherwise(none).cast(_FOUND)

    there = lambda x: x.isNotNull()
    zero = F.struct(none.alias("held"), F.lit(0).alias("covered"))
    left = F.reverse(F.filter(bound(F.reverse(whole), lambda w: scan(w, F.lit(2**31 - 1), back, _FOUND)), there))
    swept = F.filter(bound(left, lambda w: scan(w, zero, step, _FOUND)), there)
    return F.when(F.size(more) > 0, swept).otherwise(F.array().cast(f"array<{_FOUND}>"))


def detect(docs: DataFrame, model: dict[str, Trees] | None = None, text: str = "text") -> DataFrame:
    """docs with base and spans, arrays of (kind, start, end): what the rules found, and that with what the trees selected; and secrets,
    an array of (start, end)."""
    model = train(docs, text) if model is None else model
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    docs = docs.drop(*[c for c in ("base", "spans", "secrets") if c != text]).withColumn("__text", value)
    docs = docs.withColumn("base", base_spans(F.col("__text")))
    none = F.array().cast(f"array<{_FOUND}>")
    chosen = lambda names: F.concat(none, *(_selected(names.index(k), k, needs, pattern, model[k]) for k, needs, pattern, _ in GENERATORS if k in names and k in model))
    docs = docs.withColumns({"__more": chosen(KINDS), "__secret": chosen([SECRET])})
    more = F.transform(_apart(F.col("base"), F.col("__more")), lambda x: _span(x["kind"], x))
    docs = docs.withColumn("spans", F.array_sort(F.concat("base", more)))
    numbers = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    secrets = F.transform(_apart(numbers, F.col("__secret")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return docs.withColumn("secrets", secrets).drop("__more", "__secret", "__text")


def joined(spans: str | Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def redact(detected: DataFrame, text: str = "text", out: str = "redacted") -> DataFrame:
    """Add the text with each span and secret replaced by its kind in brackets; of overlapping spans the first one counts, extended."""
    names = F.array(*map(F.lit, [*KINDS, SECRET]))
    start = lambda s, kind: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind"))
    by_start = F.array_sort(F.concat(F.transform("spans", lambda s: start(s, s["kind"])), F.transform("secrets", lambda s: start(s, F.lit(len(KINDS))))))
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        gap = F.substring(value, at + 1, s["start"] - at)
        piece = F.when(s["start"] < at, "").otherwise(F.concat(gap, F.lit("["), names[s["kind"]], F.lit("]")))
        return F.greatest(at, s["end"]), piece

    last = F.coalesce(F.array_max(F.transform(by_start, lambda s: s["end"])), F.lit(0))
    pieces = bound(by_start, lambda spans: scan(spans, F.lit(0), step, "string"))
    return detected.withColumn(out, F.concat(F.array_join(pieces, ""), F.substring(value, last + 1, F.length(value))))
