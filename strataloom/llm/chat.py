r"""Chat formatting by token-level assembly.

Each turn's role and text are encoded on their own, and reserved ids (past the vocabulary) are spliced around them: turn start,
end of role, turn end. No content can therefore produce a reserved id. The loss mask is the prefix sum of +1 where an assistant's
content starts and -1 where it ends. Control strings inside a text are escaped, so that the formatted text is unambiguous too: a
backslash goes after their first character, and strings that already have backslashes there get one more, which is reversible.

Encoding is by turn, so a conversation of any length is spread over all tasks; only finished segments are brought together, and
are read in order as a stream.

Defined results: null text and null role count as empty; only the role `assistant` is under the loss mask. Turns of a conversation go by
turn (null first), then role, then text, so that repeated rows have a defined order. Rows whose conversation is null are one conversation. A very long text is one
turn, encoded whole; a very long conversation is encoded by all tasks and hashed by one, as a stream in constant memory. Extra columns
are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoder
from .common import chunks, small_batches

TURN, SAYS, END = MARKS = ["<|turn|>", "<|says|>", "<|end|>"]
TAILS = r"\|turn\|>|\|says\|>|\|end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>"
_CONTROL = re.compile(rf"([<\[])(\\*)({TAILS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({TAILS})")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


class Template:
    """Assembles turns to ids and reads them back."""

    def __init__(self, vocabulary: bytes):
        self.encoder = encoder(vocabulary)
        base = max(self.encoder.tokens) + 1
        self.reserved = {base + i: mark for i, mark in enumerate(MARKS)}
        self.turn, self.says, self.end = self.reserved

    def assemble(self, roles: list[str], texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and loss mask of each turn."""
        out = []
        for role, role_ids, ids in zip(roles, self.encoder.encode([escape(r) for r in roles]), self.encoder.encode([escape(t) for t in texts]), strict=True):
            whole = np.array([self.turn, *role_ids, self.says, *ids, self.end], np.int32)
            edges = np.zeros(len(whole) + 1, np.int8)
            if role == "assistant":
                edges[len(role_ids) + 2] += 1
                edges[len(role_ids) + 2 + len(ids)] -= 1
            out.append((whole, np.cumsum(edges[:-1], dtype=np.int8).astype(bool)))
        return out

    def text(self, ids: np.ndarray) -> str:
        """The formatted text."""
        marks, tokens = self.reserved, self.encoder.tokens
        return b"".join(marks[i].encode() if i in marks else tokens[i] for i in ids.tolist()).decode()

    def turns(self, ids: np.ndarray) -> list[tuple[str, str]]:
        """Roles and texts, read from ids alone."""
        out, decode = [], self.encoder.decode
        for a, b, c in zip(np.flatnonzero(ids == self.turn).tolist(), np.flatnonzero(ids == self.says).tolist(), np.flatnonzero(ids == self.end).tolist(), strict=True):
            out.append((unescape(decode(ids[a + 1 : b].tolist()).decode()), unescape(decode(ids[b + 1 : c].tolist()).decode())))
        return out

    def under_loss(self, ids: np.ndarray, mask: np.ndarray) -> str:
        """The text of the masked ids of one turn."""
        return unescape(self.encoder.decode(ids[mask].tolist()).decode())


def segments(turns: DataFrame, vocabulary: bytes, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, ids, loss_mask) of each turn; a conversation's ids are those of its turns in order. Narrow: no shuffle."""
    small_batches(turns.sparkSession)
    turns = turns.select(*(F.col(f"`{c}`").alias(n) for c, n in ((conv, "conv_id"), (turn, "turn"), (role, "role"), (text, "text"))))
    kinds = [turns.schema["conv_id"], turns.schema["turn"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("loss_mask", T.ArrayType(T.BooleanType()))]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        template = Template(vocabulary)
        for rows, made in _assembled(batches, template):
            more = [pa.array([ids.tolist() for ids, _ in made], pa.list_(pa.int32())), pa.array([mask.tolist() for _, mask in made], pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays([rows.column("conv_id"), rows.column("turn"), *more], ["conv_id", "turn", "ids", "loss_mask"])

    return turns.mapInArrow(run, T.StructType(kinds))


def _assembled(batches: Iterator, template: Template) -> Iterator:
    for batch in batches:
        roles, texts = ([x or "" for x in batch.column(c).to_pylist()] for c in ("role", "text"))
        for a, b in chunks(np.fromiter(map(len, texts), np.int64, len(texts))):
            yield batch.slice(a, b - a), template.assemble(roles[a:b], texts[a:b])
    template.encoder.merges.forget()


def digests(turns: DataFrame, vocabulary: bytes) -> DataFrame:
    """What the formatted conversations hold, read back from ids and masks: (conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars)."""
    small_batches(turns.sparkSession)
    turns = turns.select("conv_id", "turn", "role", "text")
    kind = turns.schema["conv_id"]
    row = T.StructType([kind, turns.schema["turn"], *(T.StructField(c, T.StringType()) for c in ("role", "text", "loss")), T.StructField("chars", T.LongType())])

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        template = Template(vocabulary)
        for rows, made in _assembled(batches, template):
            back = [template.turns(ids)[0] for ids, _ in made]
            columns = [[r for r, _ in back], [t for _, t in back], [template.under_loss(*x) for x in made], [len(template.text(ids)) for ids, _ in made]]
            types = [pa.string()] * 3 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([rows.column("conv_id"), rows.column("turn"), *map(pa.array, columns, types)], row.names)

    def join(batches: Iterator) -> Iterator:
        import pyarrow as pa

        done: list[tuple] = []
        state: list = []  # the conversation being read: id, turns, sha of turns, loss characters, sha of loss, characters

        def close() -> None:
            if state:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def flush():
            columns = list(zip(*done, strict=True)) or [[]] * 6
            done.clear()
            types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], result.names)

        conv_type = None
        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for conv, role, text, loss, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss", "chars")), strict=True):
                if not state or state[0] != conv:
                    close()
                    state[:] = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += chars
            yield flush()
        close()
        if conv_type is not None:
            yield flush()

    names = (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()))
    result = T.StructType([kind, *(T.StructField(*x) for x in names)])
    dealt = turns.mapInArrow(read, row).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(join, result)
