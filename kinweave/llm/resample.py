r"""Importance resampling of a corpus towards a target: hashed runs of words, gains, a random draw without replacement.

A text's words and their offsets come from an untrained Split of the tokenizers library over its ASCII-lowered form; features
are all runs of one to three consecutive words, joined by one blank. Each run is a pair of offsets into the words so joined, and
its bucket is the CRC-32 of the bytes between them. Two histograms of buckets (corpus and target) give each bucket a gain,
the logarithm of the ratio of its smoothed shares; a document's weight is the sum over its features. Adding Gumbel noise
drawn from a hash of the id and keeping the highest scores draws documents without replacement in proportion to
the exponential of their weights.

Texts are cut into words once and never shuffled; their buckets are written as a table, which the histogram and the weights
read. A task sends one row a bucket; the gains (one number a bucket) are the only thing on the driver. Scores, not texts, are
ordered, by ranges. A long text is cut at separators into slices, the last words of a slice begin the next, so memory holds a
slice's words and the buckets of a text.

Decisions: a null text has no words; a text without words weighs 0 and is never drawn while ``least_words`` is above 0.
Equal rows are drawn one by one; a null id draws by the hash of its empty text and stands last among equal scores. An empty
table gives no rows; an empty target makes every gain depend on the corpus alone.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import add_row_id
from ..session import stage, stage_measured, unstage
from .common import SLICE_CHARS, arrow_rows, arrow_schema, as_batch, map_batches

#: Fixed value: what a word is made of (digits, small ASCII letters and everything beyond ASCII).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SEPARATOR = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")

WIDEST = 3
BUCKETS = 10_000
PERCENT = 5
LEAST_WORDS = 20
SEED = 42


class Words:
    """The words of a text with their offsets, by the library's untrained Split."""

    def __init__(self):
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)

    def slices(self, text: str, limit: int = SLICE_CHARS) -> Iterator[tuple[list[str], list[int]]]:
        """Words and their lengths in bytes for slices of about ``limit`` characters that end between words."""
        # bytes.lower() changes A to Z only
        text = text.encode("utf-8", "replace").lower().decode("utf-8")
        low = 0
        while low < len(text):
            end = _SEPARATOR.search(text, low + limit) if low + limit < len(text) else None
            high = end.start() if end else len(text)
            found = self.split.pre_tokenize_str(text[low:high])
            words = [w for w, _ in found]
            if text.isascii():
                yield words, [b - a for _, (a, b) in found]
            else:
                yield words, [len(w.encode("utf-8")) for w in words]
            low = high


def _crc_of_runs(words: list[str], sizes: list[int], fresh: int) -> list[int]:
    """CRC-32 of every run of up to three words that ends in one of the words from number ``fresh`` on."""
    # offsets of the words when joined by one blank; a run is the pair of its first word's start and its last one's end
    view = memoryview(" ".join(words).encode("utf-8"))
    ends = [e - 1 for e in accumulate(n + 1 for n in sizes)]
    starts = [e - n for e, n in zip(ends, sizes, strict=True)]
    found: list[int] = []
    for width in range(1, WIDEST + 1):
        first = max(fresh - width + 1, 0)  # the run that ends in the first fresh word, if so many stand before it
        found += [zlib.crc32(view[a:b]) for a, b in zip(starts[first:], ends[first + width - 1 :], strict=False)]
    return found


def features(text: str, words: Words, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words of a text and the bucket of each of its features."""
    n, parts, kept, lengths = 0, [], [], []
    for some, sizes in words.slices(text):
        line, lengths = kept + some, lengths + sizes
        parts.append(np.array(_crc_of_runs(line, lengths, len(kept)), dtype=np.uint32) % np.uint32(buckets))
        n, kept, lengths = n + len(some), line[1 - WIDEST :], lengths[1 - WIDEST :]
    return n, np.concatenate(parts).astype(np.uint16) if parts else np.zeros(0, dtype=np.uint16)


def featurise(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words and features (two bytes each, a bucket) of every document; a table, as texts are cut into words once."""

    def work(batch):
        words = Words()
        found = [features(t.as_py() or "", words, buckets) for t in batch.column(1)]
        return {"doc_id": batch.column(0), "n_words": [n for n, _ in found], "features": [f.tobytes() for _, f in found]}

    with arrow_rows(docs.sparkSession, 2000):
        return stage(map_batches(docs.select("doc_id", "text"), work, "doc_id long, n_words long, features binary"), "features")


def histogram(featured: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket (one bounded array); tasks send their sums only."""
    schema = "bucket int, n long"
    fields = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for held in batch.column(0):
                count += np.bincount(np.frombuffer(held.as_py(), dtype=np.uint16), minlength=buckets)
        some = np.flatnonzero(count)
        yield as_batch({"bucket": pa.array(some.astype(np.int32)), "n": pa.array(count[some])}, fields)

    out = np.zeros(buckets, dtype=np.int64)
    sums = featured.select("features").mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in sums.collect():  # at most one row a bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of the B buckets."""
    size, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * (all_source + size) / ((s + 1.0) * (all_target + size))))
            for s, t in zip(source.tolist(), target.tolist(), strict=True)
        ],
        dtype=np.int64,
    )


def noise(doc_id: int | None, seed: int) -> int:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of a hash of the seed and the id."""
    key = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(featured: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score (weight plus noise) of every document."""

    def work(batch):
        doc_id = batch.column(0).to_pylist()
        runs = [np.frombuffer(f.as_py(), dtype=np.uint16) for f in batch.column(2)]
        weight = [int(gain[r].sum()) for r in runs]
        return {
            "doc_id": batch.column(0),
            "n_words": batch.column(1),
            "n_features": [len(r) for r in runs],
            "weight": weight,
            "score": [w + noise(i, seed) for i, w in zip(doc_id, weight, strict=True)],
        }

    schema = "doc_id long, n_words long, n_features long, weight long, score long"
    return map_batches(featured.select("doc_id", "n_words", "features"), work, schema)


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with n_words, n_features, weight, score and rank (null if not drawn).

    Of the N documents with ``least_words`` words or more the floor(percent N / 100) highest scores are drawn,
    equal scores by the smaller id; ``target`` has a column ``text``.
    """
    if buckets > 1 << 16:
        raise ValueError("a bucket takes two bytes")
    own = featurise(docs, buckets)
    wanted = featurise(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets)
    gain = gains(histogram(own, buckets), histogram(wanted, buckets))
    able = F.col("n_words") >= least_words
    scored, seen = stage_measured(
        weigh(own, gain, seed), "weights", able=F.coalesce(F.sum(able.cast("long")), F.lit(0))
    )
    unstage(own)
    unstage(wanted)
    drawn = percent * seen["able"] // 100
    keyed = scored.withColumns({"_late": ~able, "_down": -F.col("score"), "_none": F.col("doc_id").isNull()})
    placed = add_row_id(keyed, ["_late", "_down", "_none", "doc_id"], out="_place")
    rank = F.when(F.col("_place") <= drawn, F.col("_place"))
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.cast("long").alias("rank"))


def draw(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """The drawn rows of ``docs``, of which each has one id; a table, written once."""
    ids = ranked.where("rank is not null").select(F.col("doc_id").alias("_id"))
    return stage(docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi"), "drawn")
