"""Session helpers: reliable intermediate tables, size checks and ordered slicing.

Nothing here keeps data on one executor: an intermediate result that is read more than once, or
that ends a long lineage, becomes a Parquet table below ``spark.checkpoint.dir``, so it survives the
loss of the executors that wrote it and carries true size statistics for the next join.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN_DIRS: dict[str, str] = {}

# A side is broadcast only when a check has shown it to hold at most this many rows and bytes.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only where none is named and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="kinweave-")
    return _OWN_DIRS[app]


def _root(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}"


def _path(spark: SparkSession, label: str) -> str:
    return f"{_root(spark)}/{label}-{uuid.uuid4().hex}"


class Scratch:
    """The tables staged inside a :func:`scratch` block."""

    def __init__(self):
        self.paths: list[str] = []
        self.kept: set[str] = set()

    def keep(self, df: DataFrame) -> DataFrame:
        """The staged table ``df`` outlives the block."""
        self.kept.add(df._staged_at)
        return df


_SCRATCH: contextvars.ContextVar[Scratch | None] = contextvars.ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Deletes, when the block ends, every table staged inside it that was not given to ``keep``.

    What leaves the block must be a kept table or numbers, not a plan that still reads a deleted one.
    """
    outer = _SCRATCH.get()
    mine = Scratch()
    token = _SCRATCH.set(mine)
    try:
        yield mine
    finally:
        _SCRATCH.reset(token)
        for path in mine.paths:
            if path not in mine.kept:
                _delete(spark, path)
            elif outer is not None:
                outer.paths.append(path)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, keeps statistics, survives lost executors."""
    spark = df.sparkSession
    path = _path(spark, label)
    if (open_scratch := _SCRATCH.get()) is not None:
        open_scratch.paths.append(path)
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def stage_measured(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """:func:`stage`, with aggregates observed while writing, so that they need no job of their own."""
    seen = Observation()
    staged = stage(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), label)
    return staged, seen.get


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads (superseded rounds of an iteration); other tables stay."""
    if (path := vars(df).get("_staged_at")) is not None:
        _delete(df.sparkSession, path)


def _row_bytes(df: DataFrame) -> Column:
    """Rough width of a row: bytes of text and binary, also in arrays; eight per array element or other value."""
    width = F.lit(0)
    for f in df.schema:
        texts = isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.StringType, T.BinaryType))
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            part = F.octet_length(f.name)
        elif texts:
            part = F.aggregate(f.name, F.lit(0), lambda n, x: n + 8 + F.coalesce(F.octet_length(x), F.lit(0)))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            part = F.size(f.name) * 8
        else:
            part = F.lit(8)
        width = width + F.coalesce(part, F.lit(0))
    return width


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True if ``df`` has been counted to hold at most ``rows`` rows and ``size`` bytes."""
    got = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(_row_bytes(df))).first()
    return got[0] <= rows and (got[1] or 0) <= size


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast hint behind a check of rows and bytes; a bigger side keeps the join Spark plans."""
    return F.broadcast(df) if is_small(df) else df
