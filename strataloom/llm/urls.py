r"""URL filters by a bit-parallel wildcard automaton.

Glob rules over canonical URLs are packed into multiword Shift-And masks: each pattern owns one bit per literal, a `*` is a
self-loop on the bit before it, and all patterns advance together, one byte of every URL of a batch at a time. The canonical URL
is `.` + host + `\n` + path; a pattern is two globs, one for the host and one for the path, joined by `\n`. A `*` before the line
feed loops on all bytes but the line feed, so that it can't run out of the host; the first line feed is always the separator,
as a host's own line feeds are written as `\x00`.

Defined results: a null URL, or one without `://`, has empty host and path and fits no rule. A very long URL is judged whole. Rows repeat
and tie freely. Among rules that fit, the longest wins; equal lengths go by the order of the list. Extra columns pass through, whatever
their names (columns called host, path, rule or verdict are replaced). An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: (verdict, rule): a rule fits its host and all subdomains if the path starts with the rule's path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: (verdict, host glob, path glob) where no rule fits; a glob sees `.` + host. The first that fits decides; none: allow.
GLOBS = [
    ("block", "*spam*", "*"),
    ("block", "*.ads.*", "*"),
    ("block", "*.ad*server*.*", "*"),
    ("block", "*casino*", "*"),
    ("block", "*", "*/wp-login*"),
    ("block", "*", "*.exe"),
    ("block", "*", "*/tracking/*"),
]


def canonical(url: str = "url") -> tuple:
    """Columns host and path of a URL column."""
    text = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, path


class Automaton:
    """Shift-And over many glob patterns. Each is (host glob, path glob)."""

    def __init__(self, patterns: Sequence[tuple[str, str]]):
        literals: list[int] = []
        loops: list[tuple[int, bool]] = []  # bit, in the host
        starts, finals, always = [], [], []
        for host, path in patterns:
            starts.append(len(literals))
            bit = len(literals)
            literals.append(-1)  # the state before any byte; set once, at the start
            for part, inside in ((host, True), ("\n", True), (path, False)):
                for byte in part.encode():
                    if byte == ord("*"):
                        loops.append((bit, inside))
                    else:
                        bit = len(literals)
                        literals.append(byte)
            finals.append(bit)
            always.append(False)
        self.bits, self.words = len(literals), -(-len(literals) // 64)
        one = lambda bits: np.bitwise_or.reduce([self._bit(b) for b in bits], axis=0) if bits else np.zeros(self.words, np.uint64)
        self.first = one(starts)
        self.finals = finals
        self.step = np.zeros((256, self.words), np.uint64)
        for b, byte in enumerate(literals):
            if byte >= 0:
                self.step[byte] |= self._bit(b)
        self.loop = np.zeros((256, self.words), np.uint64)
        free, held = one([b for b, inside in loops if not inside]), one([b for b, inside in loops if inside])
        self.loop[:] = free | held
        self.loop[10] = free
        self.literals = literals

    def _bit(self, b: int) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        out[b // 64] = np.uint64(1) << np.uint64(b % 64)
        return out

    def match(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(rows, patterns) booleans: whether each whole row fits each pattern."""
        n = len(offsets) - 1
        lengths = offsets[1:] - offsets[:-1]
        order = np.argsort(-lengths, kind="stable")  # rows still running are a prefix
        states = np.tile(self.first, (n, 1))
        running = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
        top = np.uint64(63)
        for j, k in enumerate(running):
            live = states[:k]
            byte = data[offsets[order[:k]] + j]
            moved = live << np.uint64(1)
            moved[:, 1:] |= live[:, :-1] >> top
            states[:k] = moved & self.step[byte] | live & self.loop[byte]
        out = np.empty((n, len(self.finals)), bool)
        out[order] = np.stack([(states[:, b // 64] >> np.uint64(b % 64)).astype(np.uint8) & 1 for b in self.finals], axis=1).astype(bool) if self.finals else False
        return out


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, globs: Sequence[tuple[str, str, str]] = GLOBS, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict, and matched: the rule or glob that decided, else null. Columns of these names are
    replaced. Narrow: no shuffle."""
    small_batches(pages.sparkSession)
    host, path = canonical(url)
    own = ["host", "path", "rule", "verdict", "matched"]
    pages = pages.drop(*[c for c in own if c != url])
    pages = pages.withColumns({"host": host, "path": path})
    schema = T.StructType([*pages.schema.fields, *(T.StructField(c, T.StringType()) for c in own[2:])])
    ranked = sorted(range(len(rules)), key=lambda i: -len(rules[i][1]))
    patterns = [(f"*.{h}", f"/{p}*") for h, _, p in (rules[i][1].partition("/") for i in ranked)] + [(h, p) for _, h, p in globs]
    names = [rules[i][1] for i in ranked] + [f"{h} {p}" for _, h, p in globs]
    verdicts = [rules[i][0] for i in ranked] + [g[0] for g in globs]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        automaton = Automaton(patterns)
        for batch in batches:
            rows = [f".{(h or '').replace(chr(10), chr(0))}\n{p or ''}".encode() for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))])
            fits = automaton.match(np.frombuffer(b"".join(rows), np.uint8), offsets.astype(np.int64))
            hit = np.where(fits.any(1), fits.argmax(1), -1).tolist()
            more = [[names[i] if 0 <= i < len(rules) else None for i in hit], [verdicts[i] if i >= 0 else "allow" for i in hit], [names[i] if i >= 0 else None for i in hit]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(m, pa.string()) for m in more)], schema.names)

    return pages.mapInArrow(run, schema)
