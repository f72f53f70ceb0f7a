r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its context and only its
reply is trainable. Contexts of one conversation are prefixes of each other, so a conversation is
written once as a stream of turn segments, and an example is a row of offsets into that stream: its text
is ``stream[0:text_end]``, its trained part ``stream[loss_start:loss_end]``. Each example also holds the digest of its whole
context, which is compared with the stream when examples are read back. The output grows with the
turns, not with their square; :func:`example_texts` writes examples out in full where a trainer wants that.

A segment is ``<|turn|>role\ntext<|end|>\n``. Inside roles and texts every backslash, ``<`` and ``[`` gets
a backslash (in roles also a line break), so no control string of this or of the bracketed
templates survives unmarked, and taking the marks away gives the text back.

Decisions: turns go by turn number, then role, then text; equal rows are turns of their own. A null
role or text is empty; rows with a null conversation id are one conversation; nulls in ``turn`` come first. A
conversation without an assistant has no example. A conversation is read by one task as a sorted stream
that spills to disk, so memory holds one turn and not one conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import arrow_schema, as_batch, shuffle_partitions

TURN, END = "<|turn|>", "<|end|>\n"


def escape(text: Column, header: bool = False) -> Column:
    return F.regexp_replace(text, r"([\\<\[\n])" if header else r"([\\<\[])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, position, segment, start (offset in the stream), loss_start, loss_end (null if not trained)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(TURN), escape(role, header=True), F.lit("\n"))
    body = escape(text)
    order = Window.partitionBy("conv_id").orderBy("turn", "_role", "_text")
    before = F.coalesce(F.sum("_len").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    made = turns.select("conv_id", "turn", role.alias("_role"), text.alias("_text"), head.alias("_h"), body.alias("_b"))
    made = made.withColumn("segment", F.concat("_h", "_b", F.lit(END))).withColumn("_len", F.length("segment"))
    placed = made.withColumns({"position": F.row_number().over(order), "start": before.cast("long")})
    trained = F.when(F.col("_role") == "assistant", F.col("start") + F.length("_h"))
    return placed.select(
        "conv_id",
        "position",
        "segment",
        "start",
        trained.cast("long").alias("loss_start"),
        (trained + F.length("_b")).cast("long").alias("loss_end"),
    )


def _streams(rows: DataFrame) -> DataFrame:
    """Each conversation whole in one task, in order, as a sort that spills."""
    n = shuffle_partitions(rows.sparkSession)
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "position")


def expand(formatted: DataFrame) -> DataFrame:
    """One row for each assistant turn: its whole context (as an offset and a digest), its reply and its trained part.

    ``context_sha256`` is the digest of the stream up to ``context_end``: all preceding turns of the example.
    """
    schema = (
        "conv_id long, example int, position int, context_turns int, context_end long, context_sha256 string, "
        "loss_start long, loss_end long, text_end long"
    )
    fields = arrow_schema(schema)
    columns = ("conv_id", "position", "segment", "start", "loss_start", "loss_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun, example, context = None, False, 0, hashlib.sha256()
        for batch in batches:
            out = []
            for own, position, segment, start, low, high in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if not begun or own != conv:
                    conv, begun, example, context = own, True, 0, hashlib.sha256()
                if low is not None:
                    example += 1
                    digest = context.hexdigest()
                    out.append((own, example, position, position - 1, start, digest, low, high, start + len(segment)))
                context.update(segment.encode("utf-8", "replace"))
            if out:
                yield as_batch(dict(zip(fields.names, map(list, zip(*out, strict=True)), strict=True)), fields)

    return _streams(formatted.select(*columns)).mapInArrow(run, schema)


def example_texts(formatted: DataFrame, examples: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start, loss_end with the whole text of each given example.

    The size of this output is quadratic in the turns of a conversation by nature.
    """
    e = examples.select(F.col("conv_id").alias("_c"), "example", F.col("position").alias("_p"), "loss_start", "loss_end")
    s = formatted.select("conv_id", "position", "segment")
    met = s.join(e, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("position") <= F.col("_p")))
    parts = F.array_sort(F.collect_list(F.struct("position", "segment")))
    return met.groupBy("conv_id", "example", "loss_start", "loss_end").agg(
        F.array_join(F.transform(parts, lambda x: x["segment"]), "").alias("text")
    )


def write(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stream of segments and the examples, as tables written and read again."""
    formatted = stage(format_turns(turns), "chat-stream")
    return formatted.select("conv_id", "position", "segment"), stage(expand(formatted), "chat-examples")


def read_back(stream: DataFrame, examples: DataFrame) -> DataFrame:
    """Digests of each conversation, from the written stream and examples only.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars (of the stream), n_examples and
    example_chars (of all example texts if written in full). An example whose context is not what the stream
    holds before it raises.
    """
    segment = F.col("segment")
    inner = F.substring(segment, len(TURN) + 1, 1 << 30)
    text = F.expr(f"substring(_inner, length(_role) + 2, length(_inner) - length(_role) - 1 - {len(END)})")
    parsed = stream.select("conv_id", "position", segment, inner.alias("_inner"))
    # possessive, so that a long role is read by a loop and not by recursion
    parsed = parsed.withColumn("_role", F.regexp_extract("_inner", r"(?s)^((?:[^\\\n]++|\\.)*+)\n", 1))
    parsed = parsed.withColumn("text", unescape(text)).withColumn("role", unescape(F.col("_role")))
    e = examples.select(F.col("conv_id").alias("_c"), F.col("position").alias("_p"), "context_end", "context_sha256", "loss_start", "loss_end", "text_end")
    met = parsed.join(e, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("position") == F.col("_p")), "left")
    loss = F.expr("substring(segment, int(loss_start - context_end + 1), int(loss_end - loss_start))")
    rows = met.select(
        "conv_id", "position", "role", "text", "segment", unescape(loss).alias("loss"), "context_end", "context_sha256", "text_end"
    )
    sorted_rows = _streams(rows)
    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, n_examples long, example_chars long"
    )
    fields = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = fields.names
        done: dict[str, list] = {k: [] for k in names}
        now = None

        def close():
            values = (now["id"], now["n"], now["all"].hexdigest(), now["loss_n"], now["loss"].hexdigest(),
                      now["chars"], now["examples"], now["example_chars"])
            for k, v in zip(names, values, strict=True):
                done[k].append(v)

        for batch in batches:
            for conv, _, role, text, segment, loss, begin, digest, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now["id"] != conv:
                    if now is not None:
                        close()
                    now = {"id": conv, "n": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_n": 0,
                           "stream": hashlib.sha256(), "chars": 0, "examples": 0, "example_chars": 0}
                if end is not None and (now["chars"], now["stream"].hexdigest()) != (begin, digest):
                    raise ValueError(f"conversation {conv}: the context of an example is not the stream before it")
                now["n"] += 1
                now["chars"] += len(segment)
                now["stream"].update(segment.encode("utf-8", "replace"))
                now["all"].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                if end is not None:
                    now["loss"].update(loss.encode("utf-8", "replace"))
                    now["loss_n"] += len(loss)
                    now["examples"] += 1
                    now["example_chars"] += end
            if done["conv_id"]:
                yield as_batch(done, fields)
                done = {k: [] for k in names}
        if now is not None:
            close()
            yield as_batch(done, fields)

    return sorted_rows.mapInArrow(run, schema)
