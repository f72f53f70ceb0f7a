"""Helpers shared by the training-data operators: Arrow mapping, text slices, hashing, shared files.

Operators read the columns they name and return their identifier and result columns only, so an extra
input column, whatever its name, cannot clash with a result.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_root

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Characters handled at once inside a task: bounds the numeric work arrays, not the texts.
SLICE_CHARS = 1 << 18


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of at most ``limit`` characters, each of at least one text."""
    low = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield low, i
            low, total = i, 0
        total += len(t)
    if low < len(texts):
        yield low, len(texts)


def texts_of(column: pa.Array) -> list[str]:
    """The texts of an Arrow column; a null counts as empty."""
    return [t or "" for t in column.to_pylist()]


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Fewer rows in an Arrow batch for the jobs run inside: bounds what a worker holds of long rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


def release_memory() -> None:
    """Gives freed memory back at the end of a task; Spark keeps the worker for tasks of other kinds."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(
    df: DataFrame, work: Callable[[pa.RecordBatch], Iterable[dict[str, list]] | dict], schema: str
) -> DataFrame:
    """``work`` on every Arrow batch; it gives columns by name, as one dict or several."""
    fields = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = work(batch)
                for columns in [made] if isinstance(made, dict) else made:
                    yield as_batch(columns, fields)
                made = columns = None
            batch = None
        release_memory()

    return df.mapInArrow(run, schema)


def as_batch(columns: dict, fields: pa.Schema) -> pa.RecordBatch:
    """A batch of named columns, lists or Arrow arrays, in the types of ``fields``."""

    def typed(field: pa.Field):
        c = columns[field.name]
        if not isinstance(c, pa.Array):
            return pa.array(c, type=field.type)
        return c if c.type == field.type else c.cast(field.type)

    return pa.RecordBatch.from_arrays([typed(f) for f in fields], schema=fields)


def crc32_fold(column: str, folds: int):
    """crc32 of an id's decimal text, modulo ``folds``; a missing id is in no fold (null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)  # fixed values: multipliers of the splitmix64 finaliser
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64)."""
    x = x + _GOLDEN
    x ^= x >> np.uint64(30)
    x *= _MIX_A
    x ^= x >> np.uint64(27)
    x *= _MIX_B
    x ^= x >> np.uint64(31)
    return x


class WordHashes:
    """64-bit hashes of words, remembered up to a number of words per task (memory, not results)."""

    def __init__(self, limit: int = 200_000):
        self.known: dict[str, int] = {}
        self.limit = limit

    def __call__(self, words: list[str]) -> np.ndarray:
        import xxhash

        known, one = self.known, xxhash.xxh3_64_intdigest
        if len(known) > self.limit:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = one(w.encode("utf-8", "surrogatepass"))
            out.append(h)
        return np.array(out, dtype=np.uint64)


def word_windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words; fewer words make one run of all; none makes none."""
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, len(hashes))):
        out = mix64(out ^ hashes[k : k + n])
    return out


# -- files of our own formats, below the folder all executors share ------------------------------


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own below the shared checkpoint folder, made by the filesystem that holds it."""
    path = f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    return path


def open_folder(uri: str):
    """(filesystem, path) of a folder address, in a task: file, hdfs, s3 and gs addresses."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


class AttemptFile:
    """A file written under a name of its task attempt; only attempts that end are listed by name.

    A repeated or speculative attempt writes another file, so a lost executor leaves nothing half
    written under a listed name. The caller returns ``name`` as a row of its manifest.
    """

    def __init__(self, folder: str, stem: str):
        self.fs, root = open_folder(folder)
        self.name = f"{stem}-{uuid.uuid4().hex[:12]}"
        self.path = f"{root}/{self.name}"
        self.stream = self.fs.open_output_stream(self.path, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()


def read_file(folder: str, name: str):
    """A buffered input stream on a listed file."""
    fs, root = open_folder(folder)
    return fs.open_input_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20)


def spread(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """A short manifest dealt out one row to a task or so, to be worked on in parallel.

    Without a key: one that the rows are dealt by already would be left out of the plan.
    """
    return rows.repartition(shuffle_partitions(spark))


def even_share(total: int, each: int) -> int:
    """How many shares of about ``each`` a total makes, at least one."""
    return max(1, math.ceil(total / each))
