r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, and only that reply trainable. A
conversation that doesn't end on an assistant turn also gives one closing row without a trainable part, so the output
holds every turn. The template is ``<|im_start|>role\ntext<|im_end|>\n``; a ``<|`` inside a text (or ``<\|``, ``<\\|`` ...)
gains one backslash between the two characters, so no text can close its turn, and taking one away gives the text back.

Conversations are dealt by conv_id, sorted within the task and streamed: a task holds one conversation's text so far, not
the conversation's examples. The expansion itself writes every context again, which is quadratic in the turns of a
conversation by its definition.

Defined cases: a null text or role is empty; a null turn comes first; turns that tie are ordered by role and text, and
repeated rows stay repeated; a row with a null conv_id is a conversation of its own; a very long text is written whole; an empty table gives no example; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestep.llm.common import sliced

#: The template's marks.
START, END, ASSISTANT = "<|im_start|>", "<|im_end|>", "assistant"
SCHEMA = "conv_id long, example long, n_turns long, formatted string, loss_start long, loss_end long, closing boolean"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """A role stands on one line."""
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S))


def examples_of(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Examples of (conv_id, role, text) rows in which conversations follow one another, their turns in order."""
    conv, context, example, turns, trained = object(), "", 0, 0, True  # no conversation yet
    for conv_id, role, text in rows:
        if conv_id is None or conv_id != conv:
            if not trained:
                yield conv, example, turns, context, len(context), len(context), True
            conv, context, example, turns = conv_id, "", 0, 0
        head, body, turns = f"{context}{START}{escape_role(role)}\n", escape(text), turns + 1
        context = f"{head}{body}{END}\n"
        if trained := role == ASSISTANT:
            yield conv_id, example, turns, context, len(head), len(head) + len(body), False
            example += 1
    if not trained:
        yield conv, example, turns, context, len(context), len(context), True


def batched(rows: Iterator[tuple], schema: pa.Schema, text_at: int | None, batch_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of a bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + (len(row[text_at]) if text_at is not None else 64)
        if size >= batch_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


OUT = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("closing", pa.bool_())])
DIGEST_OUT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def chat_examples(turns: DataFrame) -> DataFrame:
    """One row per example (loss_start, loss_end: code points of the trainable part); examples of a conversation follow one another in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in sliced(batches) for row in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        yield from batched(examples_of(rows), OUT, 3)

    text = lambda c: F.coalesce(turns[c].cast("string"), F.lit(""))
    kept = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    # rows of no conversation are dealt by what they hold
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    ordered = kept.repartition("conv_id", alone).sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


def digests_of(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Reads examples back: the loss text of each, and the turns from the last, which holds them all."""
    conv, last, loss, chars, total = object(), None, hashlib.sha256(), 0, 0

    def closed() -> tuple:
        turns, n = hashlib.sha256(), 0
        for m in TURN.finditer(last):
            turns.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
            n += 1
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), total

    for conv_id, formatted, begin, end in rows:
        if conv_id is None or conv_id != conv or last is None:
            if last is not None:
                yield closed()
            conv, loss, chars, total = conv_id, hashlib.sha256(), 0, 0
        last = formatted
        text = unescape(formatted[begin:end])
        loss.update(text.encode())
        chars, total = chars + len(text), total + len(formatted)
    if last is not None:
        yield closed()


def digests(examples: DataFrame) -> DataFrame:
    """A row per conversation (a null conv_id: per row), read back from chat_examples' output in the order in which it makes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in sliced(batches) for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
        yield from batched(digests_of(rows), DIGEST_OUT, None)

    return examples.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, DIGEST)
