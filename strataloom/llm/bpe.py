"""Byte-level BPE without regular expressions.

Pre-tokenisation turns every code point into a symbol (its class, with what must be known of the next code points), and runs a
small automaton over the symbols of a whole batch. The automaton's transition functions form a finite monoid, so that it runs as
an associative scan: each block of symbols is composed to one function, the blocks' functions are prefix-composed by doubling,
and a second pass marks the boundaries inside all blocks at once. The slices between boundaries go through a bounded cache of
pair merges. Token byte ends stay with the ids, so that any range of ids decodes on its own.

Defined results: null text counts as empty (no ids); null ids or offsets decode to empty bytes. Rows repeat and ids tie freely,
as rows are independent. Columns beside the text are passed through untouched.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks, small_batches

# The code points with the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

LETTER, NUMBER, OTHER, WHITE = range(4)
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point, computed once a process."""
    if not _classes:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[WHITE_SPACE] = WHITE
        _classes.append(table)
    return _classes[0]


# Automaton: states, then symbols. Contraction letters are counted down in SHORT (one to come) and LONG (two to come).
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, SPACED, IN_WHITE, SHORT, LONG = range(8)
S_LETTER, S_NUMBER, S_OTHER, S_QUOTE1, S_QUOTE2, S_SPACE_BEFORE, S_WHITE_LAST, S_WHITE_INNER = range(8)
FIRST = 8  # added to the symbol of a text's first code point


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece starts at this symbol."""
    if symbol >= FIRST:
        state, symbol = START, symbol - FIRST
        return _step(state, symbol)[0], True
    if symbol == S_LETTER:
        if state in (SHORT, LONG):
            return (START if state == SHORT else SHORT), False
        return IN_LETTERS, state not in (IN_LETTERS, SPACED)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, SPACED)
    if symbol in (S_OTHER, S_QUOTE1, S_QUOTE2):
        if state in (IN_OTHER, SPACED):
            return IN_OTHER, False
        return {S_OTHER: IN_OTHER, S_QUOTE1: SHORT, S_QUOTE2: LONG}[symbol], True
    if symbol == S_SPACE_BEFORE:
        return SPACED, True
    if symbol == S_WHITE_LAST:
        return START, True
    return IN_WHITE, state != IN_WHITE


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Next state and boundary by (state, symbol); element by (element, symbol); product of elements; start state by element."""
    table = np.array([[_step(s, x) for x in range(16)] for s in range(8)])
    step, mark = table[:, :, 0].astype(np.uint8), table[:, :, 1].astype(bool)
    identity = tuple(range(8))
    elements, todo, by_symbol = {identity: 0}, [identity], {}
    while todo:
        f = todo.pop()
        for x in range(16):
            g = tuple(int(step[s, x]) for s in f)
            if g not in elements:
                elements[g] = len(elements)
                todo.append(g)
            by_symbol[elements[f], x] = elements[g]
    listed = list(elements)
    kind = np.uint16
    move = np.array([[by_symbol[e, x] for x in range(16)] for e in range(len(listed))], kind)
    product = np.array([[elements[tuple(g[s] for s in f)] for g in listed] for f in listed], kind)
    return step, mark, move, product, np.array([f[START] for f in listed], np.uint8)


_STEP, _MARK, _MOVE, _PRODUCT, _APPLY = _monoid()
_BLOCK = 128


def symbols(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The automaton's input. points: code points of texts put together; starts: where each non-empty text starts."""
    n = len(points)
    kind = classes()[points]
    last = np.zeros(n, bool)
    last[starts[1:] - 1] = True
    last[-1:] = True
    after = np.full(n, WHITE, np.uint8)
    after[:-1] = kind[1:]
    after[last] = WHITE
    out = np.array([S_LETTER, S_NUMBER, S_OTHER, S_WHITE_INNER], np.uint8)[kind]
    before_solid = (kind == WHITE) & (after != WHITE)
    out[before_solid] = np.where(points[before_solid] == 32, S_SPACE_BEFORE, S_WHITE_LAST)
    quotes = np.flatnonzero(points == 39)
    quotes = quotes[~last[quotes]]
    if len(quotes):
        one = points[quotes + 1]
        out[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = S_QUOTE1
        longer = ~last[quotes + 1]
        quotes, one = quotes[longer], one[longer]
        two = points[quotes + 2]
        pairs = (two == ord("e")) & ((one == ord("r")) | (one == ord("v"))) | (one == ord("l")) & (two == ord("l"))
        out[quotes[pairs]] = S_QUOTE2
    out[starts] += FIRST
    return out


def boundaries(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each code point."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    rows = -(-n // _BLOCK)
    fed = np.zeros(rows * _BLOCK, np.uint8)
    fed[:n] = symbols(points, starts)
    fed = np.ascontiguousarray(fed.reshape(rows, _BLOCK).T)
    whole = np.zeros(rows, np.uint16)
    for x in fed:
        whole = _MOVE[whole, x]
    shift = 1
    while shift < rows:  # prefix composition by doubling
        whole[shift:] = _PRODUCT[whole[:-shift], whole[shift:]]
        shift *= 2
    state = np.full(rows, START, np.uint8)
    state[1:] = _APPLY[whole[:-1]]
    marks = np.empty((_BLOCK, rows), bool)
    for j, x in enumerate(fed):
        marks[j] = _MARK[state, x]
        state = _STEP[state, x]
    return np.ascontiguousarray(marks.T).reshape(-1)[:n]


class _Merges(dict):
    """Ids by piece, in two generations: a piece that the young one lacks comes from the old one, or is merged."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.old: dict[bytes, tuple[int, ...]] = {}

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            whole = self.ranks.get(piece)
            ids = (whole,) if whole is not None else _merge(piece, self.ranks) if len(piece) < 64 else _merge_long(piece, self.ranks)
        self[piece] = ids
        return ids

    def age(self) -> None:
        self.old = dict(self)
        self.clear()

    def forget(self) -> None:
        self.old = {}
        self.clear()


def _merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get, none = ranks.get, 1 << 60
    pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
    return tuple(ranks[p] for p in parts)


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """As _merge(), with a heap over linked parts, for pieces where rescanning would be quadratic."""
    n = len(piece)
    ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(piece[i : ends[j]])) is not None:
            heap.append((rank, i, ends[j])) if not ready else heapq.heappush(heap, (rank, i, ends[j]))

    ready = False
    for i in range(n):
        offer(i)
    heapq.heapify(heap)
    ready = True
    alive = bytearray(b"\1") * n
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or ends[j] != end:
            continue
        alive[j] = 0
        ends[i], after[i] = ends[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = after[i]
    return tuple(out)


class Encoder:
    """Encodes and decodes batches of texts. cache_pieces bounds each of the merge cache's two generations."""

    def __init__(self, vocabulary: bytes, cache_pieces: int = 150_000):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.tokens: dict[int, bytes] = {i: t for t, i in self.ranks.items()}
        self.words = {i: str(i) for i in self.tokens}
        self.merges = _Merges(self.ranks)
        self.cache_pieces = cache_pieces

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        first = np.flatnonzero(boundaries(points, (ends - lengths)[lengths > 0]))
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=at[1:])
        data = joined.encode()
        cuts = [*at[first].tolist(), len(data)]
        if len(self.merges) > self.cache_pieces:
            self.merges.age()
        ids = list(map(self.merges.__getitem__, [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]))
        rows = np.searchsorted(first, np.concatenate([[0], ends])).tolist()
        return [list(chain.from_iterable(ids[a:b])) for a, b in zip(rows, rows[1:], strict=False)]

    def byte_ends(self, ids: list[int]) -> np.ndarray:
        """Where each token ends in the text's bytes."""
        return np.cumsum(np.fromiter(map(len, map(self.tokens.__getitem__, ids)), np.int64, len(ids)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_encoders: dict[bytes, Encoder] = {}


def encoder(vocabulary: bytes) -> Encoder:
    """One encoder a process and vocabulary, so that tasks share its cache."""
    key = hashlib.sha256(vocabulary).digest()
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def read_vocabulary(path: str) -> bytes:
    """A rank file (base64 token, space, rank by line). Its size is that of the vocabulary, not of the data."""
    with open(path, "rb") as f:
        return f.read()


def _texts(batch, column: str) -> tuple[list[str], np.ndarray]:
    texts = [t or "" for t in batch.column(column).to_pylist()]
    return texts, np.fromiter(map(len, texts), np.int64, len(texts))


def encode(docs: DataFrame, vocabulary: bytes, text: str = "text", ids: str = "ids", ends: str | None = "byte_ends") -> DataFrame:
    """docs with an array of ids and, if ends names it, an array of the byte offset at which each token ends. Narrow: no shuffle.
    Existing columns called ids or ends are replaced."""
    small_batches(docs.sparkSession)
    names = [c for c in (ids, ends) if c]
    docs = docs.drop(*names)
    kinds = (T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType()))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, k) for c, k in zip(names, kinds, strict=False))])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = encoder(vocabulary)
        for batch in batches:
            texts, sizes = _texts(batch, text)
            for a, b in chunks(sizes):
                rows = own.encode(texts[a:b])
                more = [pa.array(rows, pa.list_(pa.int32()))]
                if ends:
                    more.append(pa.array([own.byte_ends(r).tolist() for r in rows], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *more], [*batch.schema.names, *names])
        own.merges.forget()  # a worker that waits for its next task holds no cache

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that ids stand for. Null ids decode to no bytes; an id outside the vocabulary raises KeyError."""
    small_batches(encoded.sparkSession)
    encoded = encoded.drop(out)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = encoder(vocabulary)
        for batch in batches:
            data = pa.array([own.decode(r or []) for r in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, data], [*batch.schema.names, out])

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each text, decode the ids, and return (key, n_tokens, ids_sha256, ends_sha256, decoded_sha256), without sending the ids
    through the JVM. ends_sha256 is that of the token byte ends as little-endian 64-bit integers; what is decoded between them must be the
    text's bytes."""
    small_batches(docs.sparkSession)
    docs = docs.select(key, text)
    kinds = (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("ends_sha256", T.StringType()), ("decoded_sha256", T.StringType()))
    schema = T.StructType([docs.schema[key], *(T.StructField(*x) for x in kinds)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = encoder(vocabulary)
        sha = hashlib.sha256
        for batch in batches:
            texts, sizes = _texts(batch, text)
            for a, b in chunks(sizes):
                rows = own.encode(texts[a:b])
                ends = [own.byte_ends(r) for r in rows]
                decoded = [own.decode(r) for r in rows]
                for whole, at, t in zip(decoded, ends, texts[a:b], strict=True):
                    if whole != t.encode() or (at[-1] if len(at) else 0) != len(whole):
                        raise ValueError("ids or byte ends don't decode to the text")
                columns = [
                    pa.array(map(len, rows), pa.int64()),
                    pa.array([sha(",".join(map(own.words.__getitem__, r)).encode()).hexdigest() for r in rows], pa.string()),
                    pa.array([sha(x.astype("<i8").tobytes()).hexdigest() for x in ends], pa.string()),
                    pa.array([sha(x).hexdigest() for x in decoded], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(a, b - a), *columns], schema.names)
        own.merges.forget()

    return docs.mapInArrow(run, schema)
