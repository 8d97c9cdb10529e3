"""Text predicates, strips and parsers over columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What the strips look for.
LEAK_ANCHOR = "Important: Do not add any information, claims, or details that are not"
PREAMBLE_CHARS = 120
PREAMBLE_WORDS = "paraphras|condensed|rewrit|summary|version"
OPENERS = "here is|here's|here are|certainly|sure|below is|of course|the following is"
# Style rules, in a dialect that Java, RE2 and Python read alike.
HEADING = r"^\s*#{1,6}\s"
LIST_ITEM = r"^\s*(?:[-*+]|\d{1,3}[.)])\s+\S"
WEB_WORDS = (
    r"https?://|www\.|©|\bcopyright\b|all rights reserved|privacy policy|cookies?\b|\blog ?in\b|\bsign (?:in|up)\b|\bsubscribe\b"
    r"|click here|terms of (?:use|service)|\bposted (?:by|on)\b|\breply\b|\bshare this\b|\bnewsletter\b"
)


def heading(text: Column) -> Column:
    return text.rlike(HEADING)


def list_item(text: Column) -> Column:
    """Whether a line, split at line feeds alone, is a list item."""
    return text.rlike(f"(?md){LIST_ITEM}")


def web_words(text: Column) -> Column:
    return text.rlike(f"(?i){WEB_WORDS}")


def strip_leak(text: Column) -> Column:
    """Drop a leaked instruction paragraph at the start, up to the first blank line; all, where there is none."""
    at = F.instr(text, "\n\n")
    rest = F.when(at > 0, F.substring(text, at + 2, F.length(text))).otherwise("")
    return F.when(F.startswith(text, F.lit(LEAK_ANCHOR)), rest).otherwise(text)


def strip_preamble(text: Column) -> Column:
    """Drop a template preamble at the start: a first paragraph, or else a first line that ends in a colon, of at most
    PREAMBLE_CHARS characters, that opens like one and says what it is."""
    blank, line = F.instr(text, "\n\n"), F.instr(text, "\n")

    def head(at: Column) -> tuple[Column, Column]:
        raw = F.regexp_replace(F.substring(text, F.lit(1), at - 1), r"^\s+|\s+$", "")
        return raw, F.lower(raw)

    marked = lambda raw, low: (raw.rlike(r"^(?:##|\*\*)") | low.rlike(f"^(?:{OPENERS})")) & low.rlike(PREAMBLE_WORDS)
    raw, low = head(blank)
    paragraph = blank.between(1, PREAMBLE_CHARS + 1) & (marked(raw, low) | F.startswith(low, F.lit("paraphrased")) & F.endswith(raw, F.lit(":")))
    raw, low = head(line)
    says = low.rlike(PREAMBLE_WORDS) & F.endswith(raw, F.lit(":"))
    first = line.between(1, PREAMBLE_CHARS + 1) & says & (marked(raw, low) | F.startswith(low, F.lit("paraphrased")))
    after_line = F.ltrim(F.substring(text, line + 1, F.length(text)), F.lit("\n"))
    return F.when(paragraph, F.substring(text, blank + 2, F.length(text))).when(first, after_line).otherwise(text)


def scorer_clean(text: Column, most: int = 100_000) -> Column:
    """Line ends as spaces, at most so many characters, null as empty."""
    return F.substring(F.translate(F.coalesce(text, F.lit("")), "\n\r", "  "), 1, most)


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def word_count(text: Column) -> Column:
    """Runs of non-space characters: the stand-in for a tokenizer's count. Splits at single spaces, which needs no pattern."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     ")
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^A-Za-z0-9_]+"), lambda w: w != "")


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use mentions it: array functions don't share equal subexpressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def copies_input(source: Column, output: Column, share: float = 0.9) -> Column:
    """Whether more than a share of the output's words are words of the source."""
    hashes = lambda x: F.array_distinct(F.transform(words(x), lambda w: F.xxhash64(w)))  # noqa: E731  sets of longs need no comparison of strings
    part = lambda own: F.when(F.size(own) > 0, F.size(F.array_intersect(own, hashes(source))) / F.size(own) > share).otherwise(False)
    return bound(hashes(output), part)


def repeats(text: Column, window: int = 50, stride: int = 10, times: int = 5) -> Column:
    """Whether any window at a multiple of the stride occurs so many times. One pass of a pattern that looks ahead takes all windows;
    as sorted 64-bit hashes, equal ones are neighbours, so a window and the one times - 1 places on tell."""
    windows = F.sort_array(F.transform(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{window}}})).{{{stride}}}"), F.lit(1)), lambda w: F.xxhash64(w)))

    def repeated(w: Column) -> Column:
        most = F.greatest(F.size(w) - times + 1, F.lit(0))
        pairs = F.arrays_zip(F.slice(w, F.lit(1), most).alias("a"), F.slice(w, F.lit(times), most).alias("b"))
        return F.exists(pairs, lambda p: p["a"] == p["b"])

    return F.coalesce(bound(windows, repeated), F.lit(False))


def too_short(out_tokens: Column, in_tokens: Column) -> Column:
    return (out_tokens < 20) & (in_tokens > 200)


def first_difference(a: Column, b: Column, rounds: int = 31) -> Column:
    """0-based position of the first differing character, or the shorter length: a bisection over prefix equality."""
    short = F.least(F.length(a), F.length(b))
    zero = F.struct(F.lit(0).alias("lo"), short.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"] + 1) / 2).cast("int")
        same = F.substring(a, F.lit(1), mid) == F.substring(b, F.lit(1), mid)
        return F.struct(F.when(same, mid).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(mid - 1).alias("hi"))

    bits = F.sequence(F.lit(1), F.least(F.lit(rounds), F.ceil(F.log2(short + 2.0)).cast("int") + 1))
    return F.aggregate(bits, zero, halve, lambda s: s["lo"])


#: Products of lengths up to which difflib itself is the faster way to match two texts.
SMALL = 1 << 14
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _longest(a: str, b: str) -> tuple[int, int, int] | None:
    """The longest common substring (start in a, start in b, length), the first in a and then in b: a bisection over its length,
    on hashes of windows. None where hashes collide."""
    n = max(len(a), len(b))
    steps = np.ones((2, n), np.uint64)
    steps[0, 1:], steps[1, 1:] = _BASE, _INVERSE
    power, inverse = np.multiply.accumulate(steps, axis=1)
    sums = []
    for x in (a, b):
        sums.append(np.zeros(len(x) + 1, np.uint64))
        np.cumsum((np.frombuffer(x.encode("utf-32-le"), "<u4") + np.uint64(1)) * power[: len(x)], out=sums[-1][1:])
    windows = lambda s, size: (s[size:] - s[:-size]) * inverse[: len(s) - size]
    low, high, found = 0, min(len(a), len(b)), None
    while low < high:
        size = (low + high + 1) // 2
        left, right = windows(sums[0], size), windows(sums[1], size)
        hit = np.isin(left, right)
        if hit.any():
            low, found = size, (left, right, hit)
        else:
            high = size - 1
    if not found:
        return 0, 0, 0
    left, right, hit = found
    i = int(hit.argmax())
    j = int((right == left[i]).argmax())
    return (i, j, low) if a[i : i + low] == b[j : j + low] else None


def matching_chars(a: str, b: str) -> int:
    """Characters in the matching blocks of SequenceMatcher(None, a, b, autojunk=False), whose time grows with the square of the lengths."""
    from difflib import SequenceMatcher

    total, todo = 0, [(a, b)]
    while todo:
        x, y = todo.pop()
        if x in y or y in x:
            total += min(len(x), len(y))
            continue
        best = _longest(x, y) if len(x) * len(y) > SMALL else None
        if best is None:
            total += sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
        elif best[2]:
            i, j, size = best
            total += size
            todo += [(x[:i], y[:j]), (x[i + size :], y[j + size :])]
    return total


def similarity(a: Column, b: Column, most: int = 3000) -> Column:
    """Ratcliff-Obershelp ratio of two texts' first characters, no character left out as popular (no built-in says the same, so a
    vectorised Python function does)."""
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = [(p or "", q or "") for p, q in zip(x, y, strict=True)]
        return pd.Series([2.0 * matching_chars(p, q) / (len(p) + len(q)) if p or q else 1.0 for p, q in pairs])

    return ratio(F.substring(a, 1, most), F.substring(b, 1, most))


def duration_seconds(text: Column) -> Column:
    """Seconds of M, M:S, H:M:S, D-H, D-H:M or D-H:M:S."""
    has_days = F.instr(text, "-") > 0
    days = F.when(has_days, F.substring_index(text, "-", 1).cast("long")).otherwise(0)
    parts = F.split(F.when(has_days, F.substring_index(text, "-", -1)).otherwise(text), ":")
    at = lambda i: F.coalesce(F.get(parts, i).cast("long"), F.lit(0))
    n = F.size(parts)
    plain = F.when(n == 1, at(0) * 60).when(n == 2, at(0) * 60 + at(1)).otherwise(at(0) * 3600 + at(1) * 60 + at(2))
    return F.when(has_days, days * 86400 + at(0) * 3600 + at(1) * 60 + at(2)).otherwise(plain)


def log_iteration(line: Column) -> tuple[Column, Column]:
    """Iteration and consumed tokens of a progress line."""
    pattern = r"iteration:\s*(\d+)\s*/\s*\d+.*?consumed_tokens:\s*([\d.]+)([KMBT]?)"
    unit = F.regexp_extract(line, pattern, 3)
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).when(unit == "T", 1e12).otherwise(1.0)
    text = lambda i: F.nullif(F.regexp_extract(line, pattern, i), F.lit(""))
    return text(1).cast("long"), text(2).cast("double") * factor


def placeholders(text: Column) -> Column:
    """Template slots that were not filled."""
    return F.regexp_extract_all(text, F.lit(r"\{\{([A-Z0-9_]+)\}\}"), F.lit(1))
