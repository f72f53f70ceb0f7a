"""Document fingerprints by locally consistent parsing.

A text is parsed into a hierarchy of phrases. At each level runs of one symbol become one symbol; then
deterministic coin tossing gives every symbol a small label from itself and its left neighbour (the lowest
bit in which they differ, and its value), four times over, so neighbours always differ and a label
depends on a few symbols to the left only. Phrases begin where labels have a local maximum. A phrase's
name is a hash of its symbols, and the names are the symbols of the next level. Where two texts have a
substring in common, the phrases inside it are the same wherever it stands.

The fingerprint keeps the least name in each of 128 slots over the phrases of levels 2 to 4, 8 bits each
(hex). Likeness is the share of equal slots less what chance gives, an estimate of the share of phrases in
common.

Decisions: a null text is empty; two empty texts have likeness 1, an empty and another 0. A text that
becomes a single phrase before level 2 is represented by that phrase. Slots without a phrase borrow from the
next filled slot. Rows go by descending id (nulls last), ties by a hash of the text; the next document of the last row
is the first. A single row is its own next document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import arrow_schema, as_batch, map_batches, mix64, shuffle_partitions, text_slices

SLOTS = 128
LEVELS = 4
FIRST_LEVEL = 2

_U = np.uint64
_STEP = _U(0xD1342543DE82EF95)  # fixed value: a multiplier that tells places inside a phrase apart
_BIT_OF = np.zeros(67, dtype=np.uint8)  # the powers of two differ modulo 67
for _k in range(64):
    _BIT_OF[(1 << _k) % 67] = _k


def _tosses(size: int) -> np.ndarray:
    """One round of coin tossing for labels below ``size``, as a table over pairs (own, left)."""
    own, left = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    differ = own ^ left
    bit = np.zeros_like(differ)
    for k in range(size.bit_length(), -1, -1):
        bit = np.where((differ >> k) & 1 == 1, k, bit)
    return (2 * bit + ((own >> bit) & 1)).astype(np.uint8).ravel()


_SHORT = [(128, _tosses(128)), (14, _tosses(14)), (8, _tosses(8))]


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6; ``first`` marks the first symbol of each text, which is compared with nothing."""
    left = np.empty_like(symbols)
    left[1:] = symbols[:-1]
    left[first] = ~symbols[first]
    differ = symbols ^ left
    bit = _BIT_OF[(differ & (~differ + _U(1))) % _U(67)]
    out = (bit << 1) | ((symbols >> bit.astype(_U)) & _U(1)).astype(np.uint8)
    for size, table in _SHORT:
        index = out.astype(np.int16 if size <= 128 else np.int32) * np.int16(size)
        index[1:] += out[:-1]
        index[first] = out[first].astype(np.int16) * size + (out[first] ^ 1)
        out = table[index]
    return out


def _starts(text_of: np.ndarray) -> np.ndarray:
    first = np.empty(len(text_of), dtype=bool)
    first[:1] = True
    np.not_equal(text_of[1:], text_of[:-1], out=first[1:])
    return first


def _collapse(symbols: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one symbol inside a text become one symbol, named by symbol and length."""
    new = _starts(text_of)
    new[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(new)
    if len(at) == len(symbols):
        return symbols, text_of
    length = np.diff(at, append=len(symbols))
    kept, many = symbols[at], length > 1
    kept[many] = mix64(kept[many] ^ mix64(length[many].astype(_U)))
    return kept, text_of[at]


def phrases(symbols: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases and the text each belongs to."""
    symbols, text_of = _collapse(symbols, text_of)
    first = _starts(text_of)
    label = _labels(symbols, np.flatnonzero(first))
    cut = first
    if len(label) > 2:
        peak = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
        cut = first.copy()
        cut[1:-1] |= peak & ~first[2:]  # the last symbol of a text never stands alone
    at = np.flatnonzero(cut)
    length = np.diff(at, append=len(symbols))
    place = np.arange(len(symbols), dtype=_U) - np.repeat(at.astype(_U), length)
    names = np.add.reduceat(mix64(symbols + place * _STEP), at) if len(at) else symbols[:0]
    return mix64(names), text_of[at]


def sketches(texts: list[str]) -> np.ndarray:
    """A row of 128 8-bit slots for each text; all 0 only for an empty text."""
    n = len(texts)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    text_of = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in texts])
    best = np.full(n * SLOTS, np.iinfo(np.uint64).max, dtype=_U)
    symbols = codes.astype(_U)
    for level in range(1, LEVELS + 1):
        symbols, text_of = phrases(symbols, text_of)
        if level >= FIRST_LEVEL:
            take = slice(None)
        else:  # texts that are one phrase already
            take = np.flatnonzero(np.bincount(text_of, minlength=n)[text_of] == 1)
        names, of = mix64(symbols[take]), text_of[take]
        slot = of.astype(np.int64) * SLOTS + (names >> _U(57)).astype(np.int64)
        np.minimum.at(best, slot, names & _U((1 << 57) - 1))
    return _filled(best.reshape(n, SLOTS))


def _filled(best: np.ndarray) -> np.ndarray:
    """8 bits of each slot; an empty slot borrows from the next filled one, marked by the distance."""
    empty = best == np.iinfo(np.uint64).max
    none = empty.all(axis=1)
    twice = np.concatenate([empty, empty], axis=1)
    ahead = np.zeros(best.shape, dtype=np.int64)
    distance = np.zeros(len(best), dtype=np.int64)
    for k in range(2 * SLOTS - 1, -1, -1):
        distance = np.where(twice[:, k], distance + 1, 0)
        if k < SLOTS:
            ahead[:, k] = distance
    source = (np.arange(SLOTS) + ahead) % SLOTS
    source[none] = 0
    value = np.take_along_axis(best, source, axis=1)
    out = (mix64(value + ahead.astype(_U)) % _U(255) + _U(1)).astype(np.uint8)
    out[none] = 0
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two unlike slots agree by chance once in 255; a share below that counts as none."""
    chance = 1 / 255
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every text; one pass without a shuffle."""

    def work(batch):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for low, high in text_slices(texts):
            part = texts[low:high]
            yield {
                "doc_id": batch.column(0)[low:high],
                "n_chars": [len(t) for t in part],
                "fingerprint": [x.tobytes() for x in sketches(part)],
            }

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, n_chars long, fingerprint binary").withColumn(
        "fingerprint", F.lower(F.hex("fingerprint"))
    )


# -- a document, its edited text and the next document ----------------------------------------------


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as many first characters (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_COMPARED = (
    "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double"
)
# a range of ids ends with a row that holds its number, its first text and its last text
_STREAMED = _COMPARED + ", part int, first_text string, text string"


def _compared(ids: list, texts: list[str], following: list[str], next_sketch: np.ndarray | None = None) -> dict:
    """Rows of documents with their next documents; ``next_sketch`` where those are sketched already."""
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    own, other = sketches(texts), sketches(changed)
    if next_sketch is None:
        # texts follow each other, so only the last next document needs a sketch of its own
        next_sketch = np.concatenate([own[1:], sketches(following[-1:])])
    return {
        "doc_id": ids,
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "replace")).digest() for t in changed],
        "fingerprint": [x.tobytes() for x in own],
        "edited_fingerprint": [x.tobytes() for x in other],
        "near_edited": likeness(own, other),
        "near_next": likeness(own, next_sketch),
    }


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Every document compared with its edited text and with the next document in descending id order.

    Texts are dealt out once, by ranges of ids. A task compares the rows of its range as a stream; the last row
    of each range meets the first of the next range through a join over one row for each range.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # ranges are sampled on the driver, so their key holds a hash and not the text
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text").asc()]
    placed = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    fields = arrow_schema(_STREAMED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = first = None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not ids:
                continue
            if held is None:
                first = texts[0]
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            for low, high in text_slices(texts[:-1]):
                made = _compared(ids[low:high], texts[low:high], texts[low + 1 : high + 1])
                yield as_batch(made | {c: [None] * (high - low) for c in ("part", "first_text", "text")}, fields)
            held = ids[-1], texts[-1]
        if held is not None:
            end = {f.name: [None] for f in fields}
            end |= {"doc_id": [held[0]], "text": [held[1]], "first_text": [first]}
            yield as_batch(end | {"part": [TaskContext.get().partitionId()]}, fields)

    streamed = stage(placed.mapInArrow(run, _STREAMED), "fingerprints")
    edges = streamed.where("part is not null")
    # one row for each range of ids, without its texts
    lowest = F.min("part").over(Window.partitionBy())
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), lowest)
    last = edges.select("part", "doc_id", "text").join(edges.select("part", following.alias("next")), "part")
    met = last.join(edges.select(F.col("part").alias("next"), F.col("first_text").alias("following")), "next")

    def outer(batch):
        ids, texts, following = (c.to_pylist() for c in batch.columns)
        for low, high in text_slices(texts):
            after = following[low:high]
            yield _compared(ids[low:high], texts[low:high], after, sketches(after))

    closed = map_batches(met.select("doc_id", "text", "following"), outer, _COMPARED)
    rows = streamed.where("part is null").select(*closed.columns).unionByName(closed)
    hexed = {c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return rows.withColumns(hexed)
