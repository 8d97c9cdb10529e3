"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may differ from a passage by `int(n * ERROR_RATE)` edits. It is split into one piece more than that, so
that at least one piece stands unchanged in any such passage. One Aho-Corasick automaton finds all pieces in one pass over each
whole text; hits of an item on nearby diagonals make one window, which Myers' bit-parallel distance verifies.

Texts and items are compared lower-cased, with white space runs as one space. Items are read in blocks of at most BLOCK_CHARS
characters; the automaton of one block is what a task holds. Several blocks are several passes over the texts.

Defined results: null or empty texts and items match nothing. Items of fewer than MIN_CHARS characters are left out unless `short`
asks for them (the query and the pipeline do): then they match exactly, and not within a longer word. Items with null ids or repeated ids are reported under the id they have. Rows repeat freely.
Very long texts are searched whole, in linear time but for verification of hits. Of other columns only key and text are read (decontaminate()
returns all columns as they are, whatever their names); an empty table of texts or items gives no hits.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, small_batches

ERROR_RATE = 0.06
MIN_CHARS = 20
BLOCK_CHARS = 500_000


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def distances(pattern: str, text: str, anchored: bool = False) -> Iterator[int]:
    """Edit distance of the pattern to the closest substring that ends at each position of the text (Myers 1999); anchored: to
    the prefix that ends there."""
    m = len(pattern)
    top, full = 1 << (m - 1), (1 << m) - 1
    equal: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        equal[c] |= 1 << i
    plus, minus, score = full, 0, m
    for c in text:
        eq = equal[c] if c in equal else 0
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = (minus | ~(horizontal | plus)) & full
        down = plus & horizontal
        score += bool(up & top) - bool(down & top)
        up = (up << 1 | anchored) & full
        down = (down << 1) & full
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical
        yield score


def closest(pattern: str, text: str) -> tuple[int, int, int]:
    """The least distance of the pattern to a substring, and the first such substring's start and end."""
    best, end = min((d, i + 1) for i, d in enumerate(distances(pattern, text)))
    back = list(distances(pattern[::-1], text[:end][::-1], anchored=True))
    return best, end - 1 - back.index(best) if best in back else end, end


# Blocks of scripts that put no spaces between words (Thai, Lao, Myanmar, Khmer, Han, kana).
UNSPACED = [(0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]


def _joins(c: str) -> bool:
    """Whether a character makes one word with a neighbour that does."""
    return (c.isalnum() or c == "_") and not any(a <= ord(c) <= b for a, b in UNSPACED)


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] begins and ends at word boundaries."""
    return all(not (0 < at < len(text) and _joins(text[at - 1]) and _joins(text[at])) for at in (start, end))


class Matcher:
    """Pieces of a block of items. items: (index in the block, normalised text). short: search items under min_chars too, exactly."""

    def __init__(self, items: list[str], error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, short: bool = False):
        import ahocorasick

        self.items, self.min_chars = items, min_chars
        self.budget = [int(len(t) * error_rate) if len(t) >= min_chars else 0 for t in items]
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, text in enumerate(items):
            if len(text) >= max(1, 0 if short else min_chars):
                cuts = [k * len(text) // (self.budget[i] + 1) for k in range(self.budget[i] + 2)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    pieces[text[a:b]].append((i, a))
        self.automaton = ahocorasick.Automaton()
        for piece, at in pieces.items():
            self.automaton.add_word(piece, (len(piece), at))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the closest passage for each item that the normalised text holds."""
        if self.empty or not text:
            return []
        diagonals: dict[int, list[int]] = defaultdict(list)
        for end, (size, at) in self.automaton.iter(text):
            for i, offset in at:
                bisect.insort(diagonals[i], end + 1 - size - offset)
        found = []
        for i, starts in sorted(diagonals.items()):
            item, budget = self.items[i], self.budget[i]
            if len(item) < self.min_chars:
                found += [(i, 0, a, a + len(item)) for a in starts if whole_words(text, a, a + len(item))][:1]
                continue
            best = None
            k = 0
            while k < len(starts):
                first = last = starts[k]
                while k < len(starts) and starts[k] <= last + 2 * budget + 1 and starts[k] - first <= len(item):
                    last = starts[k]
                    k += 1
                low = max(0, first - budget)
                distance, a, b = closest(item, text[low : last + len(item) + budget])
                if distance <= budget and (best is None or distance < best[0]):
                    best = distance, low + a, low + b
            if best:
                found.append((i, *best))
        return found


def blocks(items: DataFrame, key: str, text: str, most: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """Items in blocks of bounded size, read one partition at a time."""
    block, size = [], 0
    for item, value in items.select(key, text).toLocalIterator():
        value = normalised(value)
        if block and size + len(value) > most:
            yield block
            block, size = [], 0
        block.append((item, value))
        size += len(value)
    if block:
        yield block


def hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", short: bool = False) -> DataFrame:
    """A row for each text and item it holds: (doc_id, item_id, distance, start_at, end_at), in characters of the normalised text."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", items.schema[item_key].dataType)] + [T.StructField(c, T.IntegerType()) for c in ("distance", "start_at", "end_at")])
    out = docs.sparkSession.createDataFrame([], schema)
    several = blocks(items, item_key, item_text)
    for n, block in enumerate(several):
        found = docs.mapInArrow(_finder(docs, block, schema, short), schema)
        # blocks beyond the first are run one by one, so that one automaton is held at a time
        out = found if not n else out.unionByName(checkpointed(found))
    return out


def _finder(docs: DataFrame, block: list[tuple], schema: T.StructType, short: bool):
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        ids, matcher = [x for x, _ in shared.value], Matcher([t for _, t in shared.value], short=short)
        for batch in batches:
            rows = [(i, *hit) for i, t in enumerate(batch.column("text").to_pylist()) for hit in matcher.find(normalised(t))]
            at = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
            more = [pa.array([ids[r[1]] for r in rows], kinds.field("item_id").type), *(pa.array([r[k] for r in rows], pa.int32()) for k in (2, 3, 4))]
            yield pa.RecordBatch.from_arrays([at.cast(kinds.field("doc_id").type), *more], schema=kinds)

    return run


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", short: bool = False) -> DataFrame:
    """docs without the rows that hold a passage of an item. Narrow: one pass for each block of items, no shuffle."""
    small_batches(docs.sparkSession)
    for block in blocks(items, item_key, item_text):
        docs = docs.mapInArrow(_filter(docs, block, text, short), docs.schema)
    return docs


def _filter(docs: DataFrame, block: list[tuple], text: str, short: bool):
    shared = docs.sparkSession.sparkContext.broadcast([t for _, t in block])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        matcher = Matcher(shared.value, short=short)
        for batch in batches:
            yield batch.filter(pa.array([not matcher.find(normalised(t)) for t in batch.column(text).to_pylist()], pa.bool_()))

    return run
