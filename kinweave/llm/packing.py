"""Best-fit packing with bins of several permitted lengths.

Documents are cut into pieces no longer than the largest permitted length; pieces are placed by best
fit in descending length: each goes into the open bin with the least room that still holds it. If none does, a
bin of the length that costs least is opened: the cost of a bin over the tokens it can expect to hold, now and
from the shorter pieces that open bins do not already await. At the end each bin shrinks to the least permitted
length that holds its contents.

Pieces of one length are alike to the packer, so it works on the histogram of lengths: at most as many
rows as the largest length, however large the input. Its plan is a list of placements (so many pieces of a
length, from rank to rank, into bins so and so); every piece finds its own by its rank among the pieces
of its length. Ranks come from counts per shard of ids, so no task holds a whole length.

Decisions: a missing or empty document (length 0 or null) has one piece of length 0, placed in no bin (bin null).
Ids may repeat; equal rows are packed separately. Pieces of one length are ordered by shard, id and piece.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import arrow_rows, even_share, map_batches

PERMITTED = (512, 1024, 2048, 4096)

#: Rows of one shard; shards only spread the ranking of pieces.
SHARD_ROWS = 100_000


def training_cost(length: int) -> float:
    """Steps and attention: a fixed share for each bin, linear work, and work with the square."""
    return 64 + length + length * length / 16384


@dataclass
class Plan:
    """Placements of the pieces in descending length, and the final bins.

    Piece number g (over all pieces by descending length) lies in the placement with the last ``first`` not
    above g: its bin is ``bin + (g - first) // per_bin``, its offset ``offset + (g - first) % per_bin * length``.
    """

    first: np.ndarray
    length: np.ndarray
    bin: np.ndarray
    per_bin: np.ndarray
    offset: np.ndarray
    bin_first: np.ndarray  # ranges of bins, ascending
    bin_length: np.ndarray
    bin_used: np.ndarray
    bins: int


def plan_bins(
    counts: dict[int, int], permitted: tuple[int, ...] = PERMITTED, cost: Callable[[int], float] = training_cost
) -> Plan:
    """Best fit over a histogram {length: pieces} of lengths from 1 to the largest permitted one."""
    sizes = sorted(permitted)
    rooms: list[int] = []  # the rooms of open bins, ascending
    groups: dict[int, list[tuple[int, int, int]]] = {}  # room: [(first bin, bins, length of the bin)]
    placed: list[tuple[int, int, int, int, int]] = []
    done = bins = awaited = 0
    shorter = sum(length * n for length, n in counts.items())

    def put(room: int, group: tuple[int, int, int]) -> None:
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append(group)

    def place(length: int, first: int, n: int, each: int, capacity: int, room: int) -> None:
        nonlocal done
        placed.append((done, length, first, each, capacity - room))
        done += n * each
        put(room - each * length, (first, n, capacity))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        shorter -= length * left
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n, capacity = groups[room].pop(0)
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
                awaited -= n * room
            else:
                free = max(0, shorter - awaited)
                capacity = min(
                    (c for c in sizes if c >= length),
                    key=lambda c: (cost(c) / _expected(c, length, left, free), -c),
                )
                first, n, room = bins, -(-left // (capacity // length)), capacity
                bins += n
            each = room // length
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            if full:
                place(length, first, full, each, capacity, room)
            if rest:
                place(length, first + full, 1, rest, capacity, room)
                awaited += room - rest * length
            untouched = n - full - (1 if rest else 0)
            if untouched:
                put(room, (first + n - untouched, untouched, capacity))
                awaited += untouched * room
            awaited += full * (room - each * length)
            left -= full * each + rest
    final = sorted((g[0], g[1], g[2] - room) for room, gs in groups.items() for g in gs)
    column = lambda rows, k: np.array([r[k] for r in rows], dtype=np.int64)
    used = column(final, 2)
    down = np.array([next(c for c in sizes if c >= u) for u in used.tolist()], dtype=np.int64)
    return Plan(*(column(placed, k) for k in range(5)), column(final, 0), down, used, bins)


def _expected(capacity: int, length: int, left: int, free: int) -> int:
    """Tokens a new bin can expect: as many pieces of this length as fit, then shorter ones not yet awaited."""
    own = min(left, capacity // length) * length
    return own + min(capacity - own, free)


def pieces_of(docs: DataFrame, tokens: str, largest: int) -> DataFrame:
    """doc_id, piece, start and length: documents cut at multiples of the largest permitted length."""
    n = F.coalesce(F.col(tokens).cast("long"), F.lit(0))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)), F.lit(largest).cast("long"))
    cut = docs.select("doc_id", n.alias("_n"), F.posexplode(starts).alias("piece", "start"))
    length = F.least(F.col("_n") - F.col("start"), F.lit(largest))
    return cut.select("doc_id", "piece", "start", length.cast("int").alias("length"))


def pack(
    docs: DataFrame,
    tokens: str = "n_tokens",
    permitted: tuple[int, ...] = PERMITTED,
    cost: Callable[[int], float] = training_cost,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Packs documents of ``tokens`` tokens each: a row for each piece, with its bin and place.

    doc_id, piece, start (in the document), length, bin_id, bin_offset, bin_length and bin_used.
    """
    with arrow_rows(docs.sparkSession, 1000):  # tokens may be counted from the texts just here
        rows = stage(pieces_of(docs, tokens, max(permitted)), "pieces")
    shards = even_share(rows.count(), shard_rows)
    shard = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id() % 64), F.lit(shards))
    rows = stage(rows.withColumn("shard", shard.cast("int")), "sharded-pieces")
    full = rows.where("length > 0")
    cells = full.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n"))
    cells = stage(cells, "length-cells")
    # one row for each length: bounded by the largest permitted length
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_bins(counts, permitted, cost)
    first_of, at = {}, 0
    for length in sorted(counts, reverse=True):
        first_of[length] = at
        at += counts[length]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((plan, first_of))  # bounded by the largest permitted length
    before = F.coalesce(
        F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    offsets = cells.select("length", "shard", before.cast("long").alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "start")) - 1
    ranked = full.withColumn("own", own).join(offsets, ["length", "shard"])
    ranked = ranked.select("doc_id", "piece", "start", "length", (F.col("before") + F.col("own")).alias("rank"))

    def work(batch):
        plan, first_of = shared.value
        length = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
        g = np.array([first_of[v] for v in length.tolist()]) + batch.column(4).to_numpy(zero_copy_only=False)
        event = np.searchsorted(plan.first, g, side="right") - 1
        k = g - plan.first[event]
        bins = plan.bin[event] + k // plan.per_bin[event]
        final = np.searchsorted(plan.bin_first, bins, side="right") - 1
        return {
            **{name: batch.column(i) for i, name in enumerate(("doc_id", "piece", "start", "length"))},
            "bin_id": bins,
            "bin_offset": plan.offset[event] + k % plan.per_bin[event] * length,
            "bin_length": plan.bin_length[final],
            "bin_used": plan.bin_used[final],
        }

    schema = (
        "doc_id long, piece int, start long, length int, bin_id long, bin_offset long, bin_length long, bin_used long"
    )
    packed = map_batches(ranked, work, schema)
    none = F.lit(None).cast("long")
    empty = rows.where("length = 0").select(
        "doc_id", "piece", "start", "length", *[none.alias(c) for c in ("bin_id", "bin_offset", "bin_length", "bin_used")]
    )
    return packed.unionByName(empty)
