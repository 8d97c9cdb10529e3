"""Token streams: packing, sample indexes, positions and masks, supervised examples.

Streams are never gathered: a document knows its start in the stream, and from that the windows it reaches into, so each piece of
text goes to its window by an equi-join key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import numbered, running_sum, total

EOS = 2


def with_eos(ids: Column, eos: int = EOS) -> Column:
    """Ids and an end token; a document without tokens stays empty."""
    return F.when(F.size(ids) > 0, F.concat(ids, F.array(F.lit(eos)))).otherwise(ids)


def stand_in_ids(text: Column, vocabulary: int = 32000) -> Column:
    """Stand-in tokenizer: a hash of each run of non-space characters."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int"), F.lit(vocabulary)).cast("int"))


def offsets(df: DataFrame, key: str, length: Column, group: str | None = None) -> DataFrame:
    """Add start and len of each document in its file's stream (or in the one stream), in the order of the key."""
    by = [group] if group else []
    summed = running_sum(df.withColumn("len", length.cast("long")), None, [*by, key], "len", "__end", by)
    return summed.withColumn("start", F.col("__end") - F.col("len")).drop("__end")


def window_pieces(df: DataFrame, ids: str, window: int, stride: int) -> DataFrame:
    """Pieces (win, at, piece) of documents with start and ids; window w covers [w * stride, w * stride + window)."""
    first = F.greatest(F.floor((F.col("start") - window) / stride) + 1, F.lit(0))
    last = F.floor((F.col("start") + F.col("len") - 1) / stride)
    hit = df.where("len > 0").withColumn("win", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("start"), F.col("win") * stride)
    high = F.least(F.col("start") + F.col("len"), F.col("win") * stride + window)
    piece = F.slice(F.col(ids), (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    return hit.withColumns({"at": low, "piece": piece})


def assemble(pieces: DataFrame, window: int, by: list[str]) -> DataFrame:
    """Full windows: (by, win, input_ids). A window holds at most `window` tokens, so its group is bounded."""
    whole = pieces.groupBy(*by, "win").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"])).alias("input_ids"))
    return whole.where(F.size("input_ids") == window)


def pack_windows(df: DataFrame, key: str, ids: str, seq_len: int, file: str) -> DataFrame:
    """Concatenate each file's documents and cut windows of seq_len + 1 tokens that don't overlap; the rest is dropped."""
    placed = offsets(df, key, F.size(ids), file)
    return assemble(window_pieces(placed, ids, seq_len + 1, seq_len + 1), seq_len + 1, [file])


def group_texts(df: DataFrame, key: str, ids: str, seq_len: int, file: str, compat: bool = False) -> DataFrame:
    """Windows of seq_len + 1 tokens that overlap by one; compat drops the last one of each group."""
    placed = offsets(df, key, F.size(ids), file)
    out = assemble(window_pieces(placed, ids, seq_len + 1, seq_len), seq_len + 1, [file])
    if compat:
        last = out.groupBy(file).agg(F.max("win").alias("__last"))
        out = out.join(last, file).where("win < __last").drop("__last")
    return out


def num_epochs(tokens: int, seq_len: int, samples: int, extra: int = 1) -> int:
    """Least number of epochs whose tokens hold so many samples."""
    return max(1, math.ceil((samples * seq_len + extra) / tokens))


def sample_index(docs: DataFrame, key: str, length: str, seq_len: int) -> DataFrame:
    """(sample, key, offset): sample i starts at token i * seq_len of the stream. A document emits the samples that start in it."""
    placed = offsets(docs.select(key, length), key, F.col(length))
    samples = F.greatest(F.floor((total(docs, length) - 1) / seq_len), F.lit(0))
    first, last = F.ceil(F.col("start") / seq_len), F.least(F.floor((F.col("start") + F.col("len") - 1) / seq_len), samples)
    hit = placed.where((F.col("len") > 0) & (last >= first)).withColumn("sample", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return hit.select("sample", key, (F.col("sample") * seq_len - F.col("start")).alias("offset"))


def fetch_samples(docs: DataFrame, key: str, ids: str, seq_len: int) -> DataFrame:
    """Tokens of each sample: the tail of one document, whole ones, and the head of the last; windows overlap by one."""
    placed = offsets(docs, key, F.size(ids)).withColumn("stream", F.lit(0))
    return assemble(window_pieces(placed, ids, seq_len + 1, seq_len), seq_len + 1, ["stream"]).drop("stream")


def positions(ids: Column, separator: int = EOS) -> Column:
    """Position of each token since the last separator before it."""
    step = lambda s, x: F.struct(F.when(x == separator, 0).otherwise(s["n"] + 1).alias("n"), F.concat(s["out"], F.array(s["n"])).alias("out"))
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(ids, zero, step, lambda s: s["out"])


def shifted(ids: Column) -> tuple[Column, Column]:
    """Inputs and labels of a window."""
    return F.slice(ids, F.lit(1), F.size(ids) - 1), F.slice(ids, F.lit(2), F.size(ids) - 1)


def document_mask(position_ids: Column) -> Column:
    """Label mask: false where the label starts a document."""
    return F.transform(F.slice(position_ids, F.lit(2), F.size(position_ids) - 1), lambda p: p != 0)


def segment_starts(position_ids: Column) -> Column:
    """Where segments start, and the length at the end."""
    at = F.filter(F.sequence(F.lit(0), F.size(position_ids) - 1), lambda i: F.get(position_ids, i) == 0)
    return F.concat(at, F.array(F.size(position_ids)))


def rank_slice(ids: Column, rank: int, ranks: int) -> Column:
    part = F.size(ids) / ranks
    return F.slice(ids, (part * rank).cast("int") + 1, part.cast("int"))


def padded(ids: Column, length: int, pad: int = -1) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def left_padded_positions(ids: Column, pad: int) -> Column:
    """Positions of a left-padded row: padding counts as position 0."""
    before = F.size(F.filter(ids, lambda x: x == pad))
    return F.transform(F.sequence(F.lit(0), F.size(ids) - 1), lambda i: F.greatest(i - before, F.lit(0)))


def split_bounds(splits: str, size: int) -> list[int]:
    """Cumulative rounded bounds of a split string `a,b,c` or `a/b/c`; the rounding residual is taken off all of them."""
    parts = [float(x) for x in splits.replace("/", ",").split(",")]
    if len(parts) != 3 or sum(parts) <= 0:
        raise ValueError(f"not three parts with a positive sum: {splits}")
    bounds = [0]
    for p in parts:
        bounds.append(bounds[-1] + round(p / sum(parts) * size))
    return [0] + [b - (bounds[-1] - size) for b in bounds[1:]]


def supervised(df: DataFrame, prompt: str, completion: str, seq_len: int, eos: int = EOS, pad: int = 0) -> DataFrame:
    """input_ids, position_ids (-1 on padding), label_mask (completion and end token only) of prompt and completion ids, truncated
    and padded to seq_len + 1."""
    length = seq_len + 1
    whole = F.slice(F.concat(F.col(prompt), F.col(completion), F.array(F.lit(eos))), 1, length)
    prompt_len = F.least(F.size(prompt), F.lit(length))
    at = F.sequence(F.lit(0), F.lit(length - 1))
    return df.withColumns({"__whole": whole, "__p": prompt_len}).withColumns({
        "input_ids": F.slice(F.concat("__whole", F.array_repeat(F.lit(pad), length)), 1, length),
        "position_ids": F.transform(at, lambda i: F.when(i < F.size("__whole"), i).otherwise(-1)),
        "label_mask": F.transform(at, lambda i: (i >= F.col("__p")) & (i < F.size("__whole"))),
    }).drop("__whole", "__p")


def valid_example(position_ids: Column, label_mask: Column) -> Column:
    return F.exists(position_ids, lambda x: x >= 0) & F.exists(label_mask, lambda x: x)


def pack_examples(df: DataFrame, key: str, length: str, capacity: int, group: str) -> DataFrame:
    """First-fit by running sum: examples of a group go to bins of so many tokens in the order of the key; an example that would cross
    a bin's end starts the next. Sequential in a group, so a Python function walks each in order."""
    schema = f"{df.schema[group].simpleString().replace(':', ' ')}, {df.schema[key].simpleString().replace(':', ' ')}, bin long, bin_offset long"
    sized = df.select(group, key, F.col(length).cast("long").alias("__n")).repartition(group).sortWithinPartitions(group, key)

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, where, used = None, 0, 0
        for one in batches:
            bins, starts = [], []
            for g, n in zip(one.column(0).to_pylist(), one.column(2).to_pylist(), strict=True):
                if g != at:
                    at, where, used = g, 0, 0
                if used and used + n > capacity:
                    where, used = where + 1, 0
                bins.append(where)
                starts.append(used)
                used += n
            yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), pa.array(bins, pa.int64()), pa.array(starts, pa.int64())], [group, key, "bin", "bin_offset"])

    return sized.mapInArrow(walk, schema)


def fill_in_middle(text: Column, key: Column, rate: float, prefix: str = "<PRE>", middle: str = "<MID>", suffix: str = "<SUF>", spm_rate: float = 0.5) -> Column:
    """Fill-in-the-middle permutation of a text: by a hash of the key, whether, where it is cut twice, and in which of two orders."""
    h = lambda salt: F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"fim{salt}:"), key.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(1_000_000)) / 1_000_000.0
    a, b = F.floor(h(1) * (F.length(text) + 1)).cast("int"), F.floor(h(2) * (F.length(text) + 1)).cast("int")
    low, high = F.least(a, b), F.greatest(a, b)
    head, mid, tail = F.substring(text, F.lit(1), low), F.substring(text, low + 1, high - low), F.substring(text, high + 1, F.length(text))
    psm = F.concat(F.lit(prefix), head, F.lit(suffix), tail, F.lit(middle), mid)
    spm = F.concat(F.lit(prefix), F.lit(suffix), tail, F.lit(middle), head, mid)
    return F.when(h(0) < rate, F.when(h(3) < spm_rate, spm).otherwise(psm)).otherwise(text)


def sentence_spans(df: DataFrame, key: str, sizes: str, target: int, long: int = 512, least: int = 2, short_rate: float = 0.1) -> DataFrame:
    """Spans (key, first, end, target) of consecutive sentences that reach a target length. A document with a sentence over `long`
    or fewer than `least` sentences gives none; a hash of (key, first) takes a short target now and then. Sequential in a document only."""
    schema = f"{df.schema[key].simpleString().replace(':', ' ')}, first int, end int, target int"

    def walk(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for one in batches:
            out = []
            for i, own in enumerate(one.column(1).to_pylist()):
                if not own or len(own) < least or max(own) > long:
                    continue
                name, first, total, want = str(one.column(0)[i].as_py()), 0, 0, 0
                for k, n in enumerate(own):
                    if first == k:
                        h = int(hashlib.md5(f"span:{name}:{k}".encode()).hexdigest()[:8], 16)
                        want = 2 + h % (target - 1) if (h >> 8) % 1000 < short_rate * 1000 else target
                    total += n
                    rest = len(own) - k - 1
                    if (total >= want and rest > 1 and k + 1 - first >= least) or rest == 0:
                        out.append((i, first, k + 1, want))
                        first, total = k + 1, 0
            at = one.column(0).take(pa.array([r[0] for r in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([at, *(pa.array([r[j] for r in out], pa.int32()) for j in (1, 2, 3))], [key, "first", "end", "target"])

    return df.select(key, sizes).mapInArrow(walk, schema)


def epoch_order(docs: DataFrame, key: str, epochs: int, separate_last: bool, rank: Column) -> DataFrame:
    """(pos, epoch, key): documents of all epochs in one hash order, with the last epoch after the others if it is separate."""
    rows = docs.select(key, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    block = (F.col("epoch") == epochs - 1).cast("int") if separate_last else F.lit(0)
    rows = rows.withColumns({"__block": block, "__rank": rank})
    return numbered(rows, ["__block", "__rank"], "pos").select("pos", "epoch", key)


def file_windows(lengths: DataFrame, order: str, tokens: str, seq_len: int) -> DataFrame:
    """Windows of each token file and the first global window of it."""
    wins = lengths.withColumn("windows", F.floor(F.col(tokens) / (seq_len + 1)))
    return running_sum(wins, None, order, "windows", "first").withColumn("first", F.col("first") - F.col("windows"))


def block_spans(df: DataFrame, key: str, sizes: str, title: str, most: int, long: int = 512, least: int = 2) -> DataFrame:
    """Blocks (key, first, end, block) of consecutive sentences that reach `most` less the title's length, with at least `least` sentences
    in a block and after it. Documents with a longer sentence than `long`, or fewer than `least`, give none. Blocks are numbered over all
    documents in the order of the key. Sequential in a document only."""
    schema = f"{df.schema[key].simpleString().replace(':', ' ')}, first int, end int"

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for one in batches:
            out = []
            for i, (own, head) in enumerate(zip(one.column(1).to_pylist(), one.column(2).to_pylist(), strict=True)):
                if not own or len(own) < least or max(own) > long:
                    continue
                first, total, target = 0, 0, most - (head or 0)
                for k, n in enumerate(own):
                    total += n
                    rest = len(own) - k - 1
                    if rest == 0 or (total >= target and rest >= least and k + 1 - first >= least):
                        out.append((i, first, k + 1))
                        first, total = k + 1, 0
            at = one.column(0).take(pa.array([r[0] for r in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([at, *(pa.array([r[j] for r in out], pa.int32()) for j in (1, 2))], [key, "first", "end"])

    return numbered(df.select(key, sizes, title).mapInArrow(walk, schema), [key, "first"], "block")
