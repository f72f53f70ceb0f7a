"""Close texts inside a block through signatures: candidates by equi-joins instead of all pairs of a block.

Edit distance: a text within d edits shares one of d + 1 even segments at nearly the same place.

Jaro-Winkler: a similarity of t asks for a Jaro similarity that depends on the common lead only, so pairs are sought in three
ways: with any lead (Jaro t), with the same first letter (at most three common ones count) and with the same
four letters. Jaro bounds the letters two texts of given lengths must share, as multisets. With letters in one fixed
order, rarest first, two texts that share enough also share two of the first few left after the lead (the prefix filter).
Keys are (lead, both lengths, the leading letters, two such letters). No pair that reaches t is missed; the measure itself
is applied to the candidates afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import BOOST_ABOVE, PREFIX_LENGTH, PREFIX_WEIGHT
from ..session import stage, unstage
from .candidates import TILE_ROWS, join_block
from .fuzzyjoin import probe_keys, segment_keys

#: Below this similarity the letters two texts must share are too few to narrow anything.
LEAST_CUT = 0.8
#: Letters in a key; more are more telling and more keys.
LETTERS = 2
#: So many of the most frequent characters are put in order by their counts; all others count as rarer.
RANKED = 4096

#: Common leading letters that are told apart: none counted, up to three, four.
_LEADS = ((0, 0), (1, PREFIX_LENGTH - 1), (PREFIX_LENGTH, PREFIX_LENGTH))


def least_jaro(cut: float, lead: int) -> float:
    """Least Jaro similarity of a pair that reaches ``cut`` with ``lead`` common leading letters."""
    gain = PREFIX_WEIGHT * lead
    return max(min(cut, BOOST_ABOVE), (cut - gain) / (1 - gain))


def shared_letters(cut: float, lead: int, a: int, b: int) -> int | None:
    """How many letters texts of ``a`` and ``b`` characters must share; None if they cannot reach ``cut``."""
    need = math.ceil((3 * least_jaro(cut, lead) - 1) * a * b / (a + b) - 1e-9)
    return need if need <= min(a, b) else None


class Signatures:
    """The keys of a text for one cut, given the lengths that occur and the order of the letters."""

    def __init__(self, cut: float, lengths: list[int], rank: dict[str, int]):
        self.cut, self.lengths, self.rank = cut, lengths, rank
        self.plans: dict[int, list[tuple[int, int, int, int]]] = {}

    def plan(self, n: int) -> list[tuple[int, int, int, int]]:
        """(letters skipped, other length, letters taken, letters in a key) for a text of ``n`` characters."""
        if n not in self.plans:
            out = []
            for skipped, lead in _LEADS:
                for other in self.lengths:
                    need = shared_letters(self.cut, lead, n, other)
                    if need is None or min(n, other) < skipped:
                        continue
                    rest = max(need - skipped, 0)
                    k = min(LETTERS, rest)
                    out.append((skipped, other, n - skipped - rest + k if k else 0, k))
            self.plans[n] = out
        return self.plans[n]

    def ordered(self, letters: str) -> list[tuple[int, str, int]]:
        """The letters of a text, each with its occurrence, rarest first (a later occurrence counts as rarer)."""
        seen: dict[str, int] = {}
        out = []
        for x in letters:
            k = seen[x] = seen.get(x, -1) + 1
            out.append((self.rank.get(x, 0) - k * RANKED, x, k))
        return sorted(out)

    def of(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(key, shorter, longer length) of every key of the text."""
        import xxhash

        n = len(text)
        kept: dict[int, list] = {}
        for skipped, other, taken, k in self.plan(n):
            if skipped not in kept:
                kept[skipped] = self.ordered(text[skipped:])
            short, long = min(n, other), max(n, other)
            start = f"{skipped}:{short}:{long}:{text[:skipped]}"
            for some in combinations(kept[skipped][:taken], k) if k else ((),):
                key = start + "".join(f"\0{x}{i}" for _, x, i in some)
                yield xxhash.xxh3_64_intdigest(key) - (1 << 63), short, long


def _letter_ranks(values: DataFrame) -> dict[str, int]:
    """The most frequent characters with a rank from 1, the most frequent last; at most RANKED rows are collected."""
    letters = values.select(F.explode(F.split("v", "")).alias("x")).where(F.col("x") != "")
    counts = letters.groupBy("x").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "x").limit(RANKED).collect()
    return {r["x"]: RANKED - k for k, r in enumerate(counts)}


def _lengths(values: DataFrame) -> list[int]:
    """The lengths that occur: one number for each."""
    return sorted(r[0] for r in values.select(F.length("v")).distinct().collect() if r[0])


def can_index(level) -> bool:
    return level.metric == "levenshtein" or level.metric == "jaro_winkler" and level.cut >= LEAST_CUT


def candidate_pairs(values: DataFrame, keys: list[str], level, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Unordered pairs of different values of a block that may be at ``level``, each once: keys with suffix _l, v_l, v_r.

    ``values`` holds the distinct (keys, v). A key that very many values share is tiled like any block.
    """
    if level.metric == "levenshtein":
        met = _by_segments(values, keys, int(level.cut), tile_rows)
    else:
        met = _by_letters(values, keys, level.cut, tile_rows)
    low, high = F.least("v_l", "v_r").alias("v_l"), F.greatest("v_l", "v_r").alias("v_r")
    return met.where("v_l <> v_r").select(*[f"{k}_l" for k in keys], low, high).distinct()


def _by_segments(values: DataFrame, keys: list[str], distance: int, tile_rows: int) -> DataFrame:
    text = F.col("v")
    probes = stage(values.select(*keys, "v", F.explode(probe_keys(text, distance)).alias("_sig")), "probes")
    segments = stage(values.select(*keys, "v", F.explode(segment_keys(text, distance)).alias("_sig")), "segments")
    return join_block(probes, segments, [*keys, "_sig"], "v", False, tile_rows)


def _by_letters(values: DataFrame, keys: list[str], cut: float, tile_rows: int) -> DataFrame:
    values = stage(values.select(*keys, "v"), "texts")
    sought = Signatures(cut, _lengths(values), _letter_ranks(values))
    fields = T.StructType([*values.schema.fields, T.StructField("_sig", T.LongType()), T.StructField("_short", T.BooleanType()), T.StructField("_long", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                at, sig, short, long = [], [], [], []
                for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    for key, a, b in sought.of(text):
                        at.append(i)
                        sig.append(key)
                        short.append(len(text) == a)
                        long.append(len(text) == b)
                taken = batch.take(pa.array(np.array(at, dtype=np.int64)))
                extra = [pa.array(sig, pa.int64()), pa.array(short, pa.bool_()), pa.array(long, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*taken.columns, *extra], names=fields.names)

    found = stage(values.mapInArrow(run, fields), "signatures")
    on = [*keys, "_sig"]
    shorter, longer = (found.where(side).select(*on, "v") for side in ("_short", "_long"))
    return join_block(shorter, longer, on, "v", False, tile_rows)


def count_candidates(values: DataFrame, keys: list[str], level, tile_rows: int = TILE_ROWS) -> int:
    """How many pairs of a block the index leaves to be measured."""
    pairs = stage(candidate_pairs(values, keys, level, tile_rows), "counted")
    n = pairs.count()
    unstage(pairs)
    return n
