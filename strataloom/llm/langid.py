"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams (1 to 3 code points of the lower-cased text, with a mark at both ends) by language and hash bucket.
Counting is a mapper that sends one dense row of counts per language and partition, summed by language. The log-probability
matrix, of buckets x languages doubles, is the only thing broadcast: its size depends on the number of languages, not on rows.
Texts are scored in numpy: the matrix rows of a batch's n-grams are gathered and summed by document.

Training rows: TRAIN_ROWS is the bound of a hash sample of the labelled rows, taken by language, so that a rare language is
learned from all it has. Each language gets TRAIN_ROWS / languages rows, or all.

Defined results: null text, or text without a letter, is `und` with score 0. So is every text if nothing could be learned.
score is the posterior of the predicted language under a uniform prior (a tie goes to the smaller name). Rows are independent,
so they may repeat; extra columns pass through (columns called lang_pred and score are replaced). A very long text is scored whole, in a
chunk of its own. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import LETTER, classes
from .common import chunks, small_batches

BUCKET_BITS = 14
ORDERS = (1, 2, 3)
TRAIN_ROWS = 40_000
SMOOTHING = 0.5
UNDETERMINED = "und"
#: A kept text's best language has more of the posterior than all others together.
LEAST_SCORE = 0.5


def held_out(key: str = "doc_id", parts: int = 3, part: int = 1) -> Column:
    """Whether crc32 of the id as text falls in the part that is not learned from. A null id is learned from."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % parts == part, F.lit(False))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams of non-empty texts, the texts' offsets in them, and whether each has a letter."""
    lowered = [f"\x02{t.lower()}\x03" for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le"), "<u4").astype(np.uint32)
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    starts = np.cumsum(lengths) - lengths
    letters = np.maximum.reduceat((classes()[points] == LETTER).astype(np.uint8), starts).astype(bool)
    out, value = np.empty((len(points), len(ORDERS)), np.uint32), np.zeros(len(points), np.uint32)
    for k, order in enumerate(ORDERS):
        # an n-gram at i ends at i; those that would reach into the text before are cut there
        value = value * np.uint32(0x01000193) if order > 1 else value
        shifted = points if order == 1 else np.concatenate([np.zeros(order - 1, np.uint32), points[: -(order - 1)]])
        if order > 1:
            for j in range(order - 1):
                cut = starts + j
                shifted[cut[cut < len(points)]] = 0
        value = (value ^ (shifted * np.uint32(0x9E3779B1))) * np.uint32(0x85EBCA6B) + np.uint32(order)
        mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[:, k] = mixed >> np.uint32(32 - BUCKET_BITS)
    return out.reshape(-1), starts * len(ORDERS), letters


def train(docs: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id", rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their log probabilities as (buckets, languages). Rows with null label or text teach nothing."""
    small_batches(docs.sparkSession)
    labelled = docs.select(F.col(f"`{label}`").alias("label"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{key}`"), F.lit("lang")).alias("at"))
    labelled = labelled.where("label is not null")
    sizes = {r[0]: r[1] for r in labelled.groupBy("label").count().collect()}  # a row a language
    names = sorted(sizes)
    if not names:
        return [], np.zeros((1 << BUCKET_BITS, 0))
    share = max(1, rows // len(names))
    rate = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(min(1.0, share / sizes[n])))])
    sampled = labelled.where("text is not null").where(F.pmod("at", F.lit(1 << 20)) < rate[F.col("label")] * (1 << 20)).select("label", "text")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for name, value in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by.setdefault(name, []).append(value)
            for name, texts in by.items():
                for a, b in chunks(np.fromiter(map(len, texts), np.int64, len(texts))):
                    totals.setdefault(name, np.zeros(1 << BUCKET_BITS, np.int64))
                    totals[name] += np.bincount(grams(texts[a:b])[0], minlength=1 << BUCKET_BITS)
        names = list(totals)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([totals[n].tobytes() for n in names], pa.binary())], ["label", "counts"])

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch.column("label").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                totals.setdefault(name, np.zeros(1 << BUCKET_BITS, np.int64))
                totals[name] += np.frombuffer(value, np.int64)
        names = list(totals)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([totals[n].tobytes() for n in names], pa.binary())], ["label", "counts"])

    schema = "label string, counts binary"
    summed = sampled.mapInArrow(count, schema).repartition("label").mapInArrow(add, schema)
    counts = np.zeros((1 << BUCKET_BITS, len(names)))
    for name, value in summed.collect():  # one row a language, of fixed size
        counts[:, names.index(name)] += np.frombuffer(value, np.int64)
    learned = [i for i in range(len(names)) if counts[:, i].sum()]
    counts = counts[:, learned] + SMOOTHING
    return [names[i] for i in learned], np.log(counts / counts.sum(0))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in ("lang_pred", "score") if c != text])
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names, judge = model[0], _judge(docs, model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            best, score = judge(batch.column(text).to_pylist())
            found = pa.array([names[i] if i >= 0 else UNDETERMINED for i in best.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found, pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def identified(docs: DataFrame, model: tuple[list[str], np.ndarray], languages: Sequence[str] | None = None, least: float = LEAST_SCORE, label: str = "lang", text: str = "text") -> DataFrame:
    """The rows of docs whose predicted language is among `languages` (all learned ones if None) with a score of at least `least`. Where
    the label is null, the prediction is put in. Narrow, and no column is added. A model that learned nothing can reject nothing: then all
    rows stay as they are."""
    small_batches(docs.sparkSession)
    names, judge = model[0], _judge(docs, model)
    if not names:
        return docs
    wanted = np.array([languages is None or n in languages for n in names])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            best, score = judge(batch.column(text).to_pylist())
            keep = pa.array((best >= 0) & wanted[best] & (score >= least))
            if label in batch.schema.names:
                at = batch.schema.get_field_index(label)
                filled = pc.coalesce(batch.column(label).cast(pa.string()), pa.array([names[i] for i in best.tolist()], pa.string()))
                batch = batch.set_column(at, batch.schema.field(at), filled.cast(batch.schema.field(at).type))
            yield batch.filter(keep)

    return docs.mapInArrow(run, docs.schema)


def _judge(docs: DataFrame, model: tuple[list[str], np.ndarray]):
    """A function of a list of texts: index of the language or -1, and score."""
    names, table = model
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def judge(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        matrix = shared.value
        texts = [t or "" for t in texts]
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        for a, b in chunks(np.fromiter(map(len, texts), np.int64, len(texts)), 1 << 18):
            if not names:
                continue
            at, starts, letters = grams(texts[a:b])
            sums = np.add.reduceat(matrix[at], starts, axis=0)
            odds = np.exp(sums - sums.max(1, keepdims=True))
            best[a:b] = np.where(letters, sums.argmax(1), -1)
            score[a:b] = np.where(letters, 1 / odds.sum(1), 0.0)
        return best, score

    return judge
