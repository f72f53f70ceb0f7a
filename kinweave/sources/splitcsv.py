"""CSV files with line breaks inside fields, read by many tasks.

A file is read as lines, by byte ranges. Whether a line ends inside a quoted field depends on how it begins, so a first scan
gives each range two answers, one for each way to begin; from the file's start on they tell how every range really begins. If
no line ends inside a field, Spark's own reader splits the file. Otherwise a second scan joins the lines of each record
inside its range; only the pieces of a record that crosses a range, at most two a range, are brought together by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ends_inside(line: str, inside: bool, sep: str = ",", quote: str = '"') -> bool:
    """Whether a line ends inside a quoted field, if it begins inside one or at the start of a field.

    A quote opens a field only as its first character; inside, a doubled quote stands for one.
    """
    i, n = 0, len(line)
    while True:
        if inside:
            i = line.find(quote, i)
            if i < 0:
                return True
            if line.startswith(quote, i + 1):
                i += 2
                continue
            inside = False
        elif i < n and line[i] == quote:
            inside, i = True, i + 1
            continue
        # to the start of the next field
        i = line.find(sep, i) + 1
        if not i:
            return False


@dataclass(frozen=True)
class _Range:
    """What a range does to a reader that begins it outside (0) or inside (1) a field."""

    ends: tuple[bool, bool]
    starts_record: tuple[bool, bool]  # whether some record begins in it
    breaks: tuple[bool, bool]  # whether some line of it ends inside a field
    returns: bool  # whether its first line ends with a carriage return


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(paths)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _ranges(lines: DataFrame, sep: str, quote: str) -> dict[tuple[str, int], _Range]:
    """One entry for each range of each file: as many as Spark's driver holds tasks of the scan."""
    # lines without a quote change nothing, so they are not sent
    told = lines.select(
        "file", "start", F.when(F.instr("value", quote) > 0, F.col("value")).alias("value"), F.endswith("value", F.lit("\r")).alias("returns")
    )
    schema = (
        "file string, start long, end0 boolean, end1 boolean, record0 boolean, record1 boolean, break0 boolean, break1 boolean, "
        "returns boolean"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        for batch in batches:
            for file, start, line, returns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state, record, broken, _ = found.setdefault((file, start), ([False, True], [False, False], [False, False], returns))
                for k in (0, 1):
                    record[k] |= not state[k]
                    if line is not None:
                        state[k] = ends_inside(line, state[k], sep, quote)
                    broken[k] |= state[k]
        rows = [(*key, *state, *record, *broken, returns) for key, (state, record, broken, returns) in found.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    rows = told.mapInArrow(run, schema).toArrow().to_pylist()
    return {
        (r["file"], r["start"]): _Range(
            (r["end0"], r["end1"]), (r["record0"], r["record1"]), (r["break0"], r["break1"]), r["returns"]
        )
        for r in rows
    }


def _beginnings(ranges: dict[tuple[str, int], _Range]) -> tuple[dict[tuple[str, int], tuple[bool, int, bool]], bool]:
    """How each range begins, the range in which the record open at its start began, and whether the file's lines end with a
    carriage return; and whether any line breaks a field."""
    out, broken = {}, False
    file, inside, owner, returns = None, False, 0, False
    for (path, start), one in sorted(ranges.items(), key=lambda x: x[0]):
        if path != file:
            file, inside, owner, returns = path, False, start, one.returns
        out[path, start] = (inside, owner, returns)
        broken |= one.breaks[inside]
        owner = start if one.starts_record[inside] else owner
        inside = one.ends[inside]
    return out, broken


def _records(lines: DataFrame, begins: dict, sep: str, quote: str, header: bool) -> DataFrame:
    """The text of every record but the files' first ones, if these are headers."""
    schema = "file string, owner long, start long, value string, whole boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, owner, parts, inside, first, returns = None, 0, [], False, False, False
        out: list[tuple] = []

        def close(ended: bool) -> None:
            """The lines held are a whole record, or the piece of one that a neighbouring range holds too."""
            nonlocal parts, first
            if parts and not (first and ended and header):
                # in a file of such lines a break in a field is read as a line feed
                lines = [p.removesuffix("\r") for p in parts] if returns else parts
                out.append((here[0], owner, here[1], "\n".join(lines), ended and owner == here[1]))
            parts, first = [], first and not ended

        for batch in batches:
            for file, start, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != (file, start):
                    close(False)
                    here, first = (file, start), start == 0
                    inside, owner, returns = begins[here]
                if not inside:
                    owner = start  # a record begins
                parts.append(line)
                inside = ends_inside(line, inside, sep, quote) if quote in line else inside
                if not inside:
                    close(True)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
                out = []
        close(False)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)

    found = lines.mapInArrow(run, schema)
    # pieces lie in order of their ranges; a record has one piece in each range it touches
    pieces = found.where("not whole").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("p"))
    joined = pieces.select(F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value"))
    every = found.where("whole").select("value").unionAll(joined)
    return every.where("value <> ''")


def read_split_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType, options: dict) -> DataFrame:
    """CSV files of one schema, whose fields may hold line breaks, read by ranges.

    Equal to Spark's multi-line reader on files that keep to the standard (quoted fields with doubled quotes, lines ended by
    a line feed, with or without a carriage return); rows may come in another order.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    sep, quote, header = options.get("sep", ","), options.get("quote", '"'), bool(options.get("header"))
    lines = _lines(spark, paths)
    begins, broken = _beginnings(_ranges(lines, sep, quote))
    if not broken:
        return spark.read.schema(schema).options(**options | {"multiLine": False}).csv(paths)
    records = _records(lines, begins, sep, quote, header)
    told = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
    told = {k: v for k, v in told.items() if k not in ("header", "enforceSchema")} | {"multiLine": "true"}
    return records.select(F.from_csv("value", _ddl(schema), told).alias("r")).select("r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
