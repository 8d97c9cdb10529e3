"""Score expressions. Inputs and results are float32, and each step is rounded to float32, as order depends on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def accumulation(batch: Column, micro: Column, ranks: Column) -> Column:
    """Gradient accumulation steps of a global batch; null where it does not divide."""
    return F.when(batch % (micro * ranks) == 0, (batch / (micro * ranks)).cast("long"))


def training_steps(tokens: Column, epochs: int, batch_tokens: int = 2_097_152) -> Column:
    return F.round(epochs * tokens / batch_tokens).cast("long")


def train_length(tokens: Column) -> Column:
    """Tokens of a document in training: one end-of-document token is appended."""
    return tokens + 1


def consensus(a: Column, b: Column, c: Column) -> Column:
    return ((a + b + c).cast("double") / 3.0).cast("float")


def disagreement(a: Column, b: Column, c: Column, q: Column) -> Column:
    """Population variance of three ranks around their float32 mean."""
    squares = (a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q)
    return (squares.cast("double") / 3.0).cast("float")


def utility(q: Column, v: Column, weight: Column) -> Column:
    return q + weight.cast("float") * F.sqrt(v).cast("float")


def points(x: Column) -> Column:
    """Percent points."""
    return x * 100


def signed(x: Column) -> Column:
    """Two decimals with a sign; minus zero is written as plus zero."""
    return F.regexp_replace(F.format_string("%+.2f", x), r"^-0\.00$", "+0.00")


def human(x: Column) -> Column:
    """Three significant digits and one of K, M, B, T."""
    power = F.least(F.greatest(F.floor(F.log10(F.greatest(F.abs(x), F.lit(1.0))) / 3), F.lit(0)), F.lit(4)).cast("int")
    scaled = x / F.pow(F.lit(1000.0), power)
    places = F.greatest(F.lit(0), 2 - F.floor(F.log10(F.greatest(F.abs(scaled), F.lit(1.0)))).cast("int"))
    text = F.when(places == 2, F.format_string("%.2f", scaled)).when(places == 1, F.format_string("%.1f", scaled)).otherwise(F.format_string("%.0f", scaled))
    trimmed = F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return F.concat(trimmed, F.element_at(F.array(*map(F.lit, ["", "K", "M", "B", "T"])), power + 1))


def learning_rate(step: Column, peak: float, least: float, warmup: int, flat_until: int, decay: int, style: str) -> Column:
    """Linear warm-up, flat, decay (cosine, linear, 1-sqrt), then the least rate, as a multiple of the peak."""
    at = (step - flat_until).cast("double") / decay
    factor = {"cosine": (1 + F.cos(F.lit(3.141592653589793) * at)) / 2, "linear": 1 - at, "1-sqrt": 1 - F.sqrt(F.greatest(at, F.lit(0.0)))}[style]
    rate = F.when(step <= warmup, peak * step / max(warmup, 1)).when(step < flat_until, peak).when(step < flat_until + decay, least + (peak - least) * factor).otherwise(least)
    return rate / peak


def address(key: Column, size: int) -> tuple[Column, Column]:
    """Shard and row of a positional id."""
    return F.floor(key / size).cast("long"), key % size


def decoder_flops(layers: int, hidden: int, heads: int, kv_heads: int, vocab: int, seq: int, ffn: int, batch: int = 1) -> float:
    """Floating-point operations of one forward and backward pass of a gated decoder."""
    head = hidden // heads
    attention = 2 * batch * seq * hidden * (heads + 2 * kv_heads) * head + 2 * 2 * batch * heads * seq * seq * head + 2 * batch * seq * heads * head * hidden
    return 3 * (layers * (attention + 3 * 2 * batch * seq * hidden * ffn) + 2 * batch * seq * hidden * vocab)
