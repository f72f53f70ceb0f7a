"""Counts of comparison patterns over all pairs of blocks, and the pairs that reach a weight, without a row for each pair.

Records, not pairs, are dealt to tasks by block (large blocks in cells of two pieces). A task takes some whole cells at a
time, numbers the values of each field, measures each two different values of a field once where values repeat, and looks the
levels of all pairs up in that table. Pairs exist only as index arrays of bounded size; what leaves a task is one count for each
pattern it met, or the few pairs whose fields can still reach the weight asked for.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.similarity import jaro_needed, jaro_winkler_pairs, scored_matches
from .candidates import split_cells
from .compare import Comparison

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pairs looked at in one step, records held before a step, and cells of a table of value pairs.
PAIRS_AT_ONCE, ROWS_AT_ONCE, TABLE_CELLS = 1 << 18, 1 << 14, 1 << 24
#: Letters of the longest text that is held as bits, cells of the tables of letters, and pairs measured in one step.
BITS, LETTER_CELLS, MEASURED_AT_ONCE = 64, 1 << 23, 1 << 15
#: Bins of letters in a signature, and how often a letter counts in its bin.
BINS, OFTEN = 32, 4

#: The side of a record that is paired with all others of its cell; otherwise sides 0 and 1 meet.
ALONE = 2

_KINDS = ("null", "exact", "levenshtein", "jaro_winkler", "else")
_TYPES = (T.StringType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DateType, T.BooleanType)


def can_tabulate(df: DataFrame, comparisons: list[Comparison]) -> bool:
    """True if every comparison goes from null and exact over known kinds to else, on text, whole numbers, dates or truth values."""
    kinds = {f.name: f.dataType for f in df.schema}

    def known(c: Comparison) -> bool:
        metrics = [l.metric for l in c.levels]
        ends = metrics[:2] == ["null", "exact"] and metrics[-1] == "else"
        return ends and set(metrics) <= set(_KINDS) and isinstance(kinds.get(c.column), _TYPES)

    return all(known(c) for c in comparisons)


def edit_distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Edit distance of each two texts up to ``most``, above that ``most + 1``; all pairs advance together."""
    la = np.fromiter(map(len, a), dtype=np.int64, count=len(a))
    lb = np.fromiter(map(len, b), dtype=np.int64, count=len(b))
    out = np.full(len(a), most + 1, dtype=np.int64)
    near = np.flatnonzero(np.abs(la - lb) <= most)
    width = int(max(la[near].max(initial=0), lb[near].max(initial=0)))
    step = max((1 << 22) // max(width, 1), 1)
    for low in range(0, len(near), step):
        some = near[low : low + step]
        out[some] = _banded(a[some], b[some], la[some], lb[some], most)
    return out


def _banded(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, most: int) -> np.ndarray:
    """Rows of the distance table one after the other, only the cells within ``most`` of the diagonal."""
    n, width = len(a), int(max(la.max(initial=0), lb.max(initial=0), 1))
    ca, cb = (x.astype(f"U{width}").view(np.uint32).reshape(n, width) for x in (a, b))
    above = most + 1
    band = np.arange(-most, most + 1)
    # cell (i, i + k) of the table stands at index k + most
    row = np.where(band >= 0, band, above)[None, :].repeat(n, axis=0)
    out = np.where(la == 0, lb, above)
    for i in range(1, int(la.max(initial=0)) + 1):
        new = np.full((n, len(band)), above, dtype=np.int64)
        for at, k in enumerate(band):
            j = i + k
            if j < 0 or j > width:
                continue
            if j == 0:
                new[:, at] = i
                continue
            best = row[:, at] + (ca[:, i - 1] != cb[:, j - 1])
            if at + 1 < len(band):
                best = np.minimum(best, row[:, at + 1] + 1)
            if at:
                best = np.minimum(best, new[:, at - 1] + 1)
            new[:, at] = best
        row = np.minimum(new, above)
        done = np.flatnonzero(la == i)
        out[done] = row[done, lb[done] - i + most]
    return np.minimum(out, above)


def levels_of(c: Comparison, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The gamma of each two different, known values of a comparison's field."""
    return _levels(c, len(a), lambda most: edit_distances(a, b, most), lambda cut: _similar(a, b, cut))


def _levels(c: Comparison, pairs: int, edits: Callable, similarity: Callable) -> np.ndarray:
    """Gammas from the edit distances up to a number, and the similarities from a cut on."""
    n = len(c.scored)
    out = np.zeros(pairs, dtype=np.int8)
    open_ = np.ones(pairs, dtype=bool)
    apart = similar = None
    for i, level in enumerate(c.scored):
        if level.metric == "levenshtein":
            if apart is None:
                apart = edits(int(max(l.cut for l in c.scored if l.metric == "levenshtein")))
            hit = apart <= int(level.cut)
        elif level.metric == "jaro_winkler":
            if similar is None:
                similar = similarity(min(l.cut for l in c.scored if l.metric == "jaro_winkler"))
            hit = similar >= level.cut
        else:  # different values are not at the exact level, and the last level takes all others
            hit = np.full(pairs, level.metric == "else")
        out[open_ & hit] = n - 1 - i
        open_ &= ~hit
    return out


def _similar(a: np.ndarray, b: np.ndarray, cut: float) -> np.ndarray:
    """Jaro-Winkler where the lengths allow ``cut``, else 0."""
    la = np.fromiter(map(len, a), dtype=np.int64, count=len(a))
    lb = np.fromiter(map(len, b), dtype=np.int64, count=len(b))
    able = np.minimum(la, lb) / np.maximum(np.maximum(la, lb), 1) >= 3 * jaro_needed(cut) - 2 - 1e-9
    out = np.zeros(len(a))
    if able.any():
        out[able] = jaro_winkler_pairs(pd.Series(a[able], dtype=object), pd.Series(b[able], dtype=object))
    return out


class Texts:
    """Texts as bits: where each letter stands, and which letters there are, so that many pairs are measured in a few steps."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.size = np.fromiter(map(len, words), dtype=np.int64, count=n)
        width = max(int(self.size.max(initial=0)), 1)
        points = words.astype(f"U{width}").view(np.uint32).reshape(n, width)
        letters, codes = np.unique(points, return_inverse=True)
        self.letters = len(letters)
        self.codes = codes.reshape(n, width).astype(np.uint8 if self.letters <= 256 else np.int32)
        at = np.arange(width)
        row, col = np.nonzero(at[None, :] < self.size[:, None])
        self.places = np.zeros(n * self.letters, dtype=np.uint64)
        cell = row * self.letters + self.codes[row, col]
        np.bitwise_or.at(self.places, cell, np.uint64(1) << col.astype(np.uint64))
        held = np.bincount(row * BINS + self.codes[row, col] % BINS, minlength=n * BINS).reshape(n, BINS)
        self.over = np.maximum(held - OFTEN, 0).sum(axis=1)
        unary = (np.uint64(1) << np.minimum(held, OFTEN).astype(np.uint64)) - np.uint64(1)
        half = BINS // 2
        shifts = np.arange(half, dtype=np.uint64) * np.uint64(OFTEN)
        self.signs = [np.bitwise_or.reduce(unary[:, k * half : (k + 1) * half] << shifts, axis=1) for k in (0, 1)]

    @staticmethod
    def of(words: np.ndarray) -> Texts | None:
        """None if a text is too long for its bits, or letters are too many for tables of bounded size."""
        longest = max(map(len, words), default=0)
        if longest > BITS or len(words) * max(longest, 1) > LETTER_CELLS:
            return None
        return Texts(words) if len(words) * (1 + len(set().union(*words))) <= LETTER_CELLS else None

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """At least as many letters as two texts share, in any order."""
        found = sum(np.bitwise_count(s[i] & s[j]).astype(np.int64) for s in self.signs)
        return found + np.minimum(self.over[i], self.over[j]) if self.over.any() else found

    def edits(self, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
        """Edit distance up to ``most``, above that some larger number."""
        out = np.full(len(i), most + 1, dtype=np.int64)
        near = np.flatnonzero(np.maximum(self.size[i], self.size[j]) - self.shared(i, j) <= most)
        for low in range(0, len(near), MEASURED_AT_ONCE):
            some = near[low : low + MEASURED_AT_ONCE]
            out[some] = self._edits(i[some], j[some])
        return out

    def _edits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """A column of the distance table at a time, its differences as the bits of two numbers."""
        one = np.uint64(1)
        n, m = self.size[i], self.size[j]
        score, out = n.copy(), n.copy()
        out[n == 0] = m[n == 0]
        base, last = i * self.letters, np.maximum(n - 1, 0).astype(np.uint64)
        up, down = np.full(len(i), ~np.uint64(0)), np.zeros(len(i), dtype=np.uint64)
        for at in range(int(m.max(initial=0))):
            equal = self.places[base + self.codes[j, at]]
            x = equal | down
            h = (((equal & up) + up) ^ up) | equal
            plus, minus = down | ~(h | up), up & h
            score += ((plus >> last) & one).astype(np.int64) - ((minus >> last) & one).astype(np.int64)
            plus, minus = (plus << one) | one, minus << one
            up, down = minus | ~(x | plus), plus & x
            done = (m == at + 1) & (n > 0)
            out[done] = score[done]
        return out

    def similarity(self, i: np.ndarray, j: np.ndarray, cut: float) -> np.ndarray:
        """Jaro-Winkler where it may reach ``cut``, else 0."""
        need = jaro_needed(cut) - 1e-9
        out = np.zeros(len(i))
        n, m = self.size[i], self.size[j]
        most = np.minimum(self.shared(i, j), np.minimum(n, m))
        near = np.flatnonzero((most > 0) & ((most / np.maximum(n, 1) + most / np.maximum(m, 1) + 1) / 3 >= need))
        for low in range(0, len(near), MEASURED_AT_ONCE):
            some = near[low : low + MEASURED_AT_ONCE]
            out[some] = self._similarity(i[some], j[some], need)
        return out

    def _similarity(self, i: np.ndarray, j: np.ndarray, need: float) -> np.ndarray:
        one, zero = np.uint64(1), np.uint64(0)
        n, m = self.size[i], self.size[j]
        reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
        base = j * self.letters
        used_a, used_b = (np.zeros(len(i), dtype=np.uint64) for _ in range(2))
        inside = np.array([[sum(1 << k for k in range(max(0, at - r), min(BITS, at + r + 1))) for at in range(self.codes.shape[1])] for r in range(int(reach.max(initial=0)) + 1)], dtype=np.uint64)
        for at in range(int(n.max(initial=0))):
            open_ = self.places[base + self.codes[i, at]] & inside[reach, at] & ~used_b
            open_[at >= n] = zero
            # the first free place of the letter
            hit = open_ & (~open_ + one)
            used_b |= hit
            used_a |= (hit != zero).astype(np.uint64) << np.uint64(at)
        k = np.bitwise_count(used_a).astype(np.int64)
        out = np.zeros(len(i))
        some = np.flatnonzero((k > 0) & ((k / np.maximum(n, 1) + k / np.maximum(m, 1) + 1) / 3 >= need))
        if len(some):
            bits = np.arange(self.codes.shape[1], dtype=np.uint64)
            marked = [((u[some, None] >> bits[None, :]) & one).astype(bool) for u in (used_a, used_b)]
            out[some] = scored_matches(self.codes[i[some]], self.codes[j[some]], n[some], m[some], *marked)
        return out


class Field:
    """The values of one field among the records held, and the levels of their pairs.

    ``rare`` holds a number for each record that depends on its value, and tells pairs of equal values apart by it.
    """

    def __init__(self, comparison: Comparison, values: list, rare: list | None = None):
        self.comparison = comparison
        self.codes, names = pd.factorize(np.array(values, dtype=object))
        self.names = np.asarray(names, dtype=object)
        self.top = len(comparison.scored) - 1
        k = len(self.names)
        measured = any(l.metric in ("levenshtein", "jaro_winkler") for l in comparison.scored)
        self.texts = Texts.of(self.names) if measured else None
        # values that hardly repeat are measured as they come
        own = self.texts is not None and 2 * k > len(values)
        self.table = np.full(k * k, -2, dtype=np.int8) if k * k <= TABLE_CELLS and not own else None
        self.kinds, self.rare = None, [None]
        if rare is not None:
            by, kinds = pd.factorize(np.array(rare, dtype=object))
            self.rare = [*kinds, None]
            self.kinds = np.full(k, len(kinds), dtype=np.int64)
            known = self.codes >= 0
            self.kinds[self.codes[known]] = np.where(by[known] >= 0, by[known], len(kinds))

    @property
    def digits(self) -> int:
        """How many patterns the field has: a missing side, each level, the exact one once for each number of ``rare``."""
        return self.top + 1 + len(self.rare)

    def _measured(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.texts is None:
            return levels_of(self.comparison, self.names[a], self.names[b])
        return _levels(
            self.comparison, len(a), lambda most: self.texts.edits(a, b, most), lambda cut: self.texts.similarity(a, b, cut)
        )

    def gammas(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The level of each pair of records: -1 where a side is missing."""
        a, b = self.codes[left], self.codes[right]
        out = np.full(len(a), -1, dtype=np.int8)
        known = (a >= 0) & (b >= 0)
        same = known & (a == b)
        out[same] = self.top
        rest = np.flatnonzero(known & ~same)
        a, b, k = a[rest], b[rest], len(self.names)
        if self.table is not None:
            pairs = a.astype(np.int64) * k + b
            new = np.unique(pairs[self.table[pairs] == -2])
            self.table[new] = self._measured(new // k, new % k)
            out[rest] = self.table[pairs]
        elif self.texts is not None:
            out[rest] = self._measured(a, b)
        else:
            different, back = np.unique(a.astype(np.int64) * k + b, return_inverse=True)
            out[rest] = self._measured(different // k, different % k)[back]
        return out

    def patterns(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The digit of each pair of records, from 0."""
        found = self.gammas(left, right).astype(np.int64) + 1
        if self.kinds is not None:
            same = np.flatnonzero(found == self.top + 1)
            found[same] += self.kinds[self.codes[left[same]]]
        return found


def _partners(group: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each record the first of the records it is paired with, and how many: they follow each other.

    Records stand by group and side: those of side 0 meet all of side 1, those of side ALONE all later ones.
    """
    n = len(group)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(first, append=n)
    zero = np.add.reduceat((side == 0).astype(np.int64), first)
    of = np.repeat(np.arange(len(first)), size)
    end = (first + size)[of]
    alone = side == ALONE
    start = np.where(alone, np.arange(n) + 1, (first + zero)[of])
    count = np.where(alone | (side == 0), end - start, 0)
    return start, count


def _steps(group: np.ndarray, side: np.ndarray, rank: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs as two index arrays, a bounded number at a time."""
    start, count = _partners(group, side)
    total = np.cumsum(count)
    low = 0
    while low < len(group):
        done = total[low - 1] if low else 0
        high = max(int(np.searchsorted(total, done + PAIRS_AT_ONCE, side="right")), low + 1)
        n = count[low:high]
        left = np.repeat(np.arange(low, high), n)
        right = np.repeat(start[low:high], n) + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        if same:  # the record with the lower id is on the left
            left, right = np.where(rank[left] < rank[right], left, right), np.where(rank[left] < rank[right], right, left)
        yield left, right
        low = high


def count_patterns(
    group: np.ndarray, side: np.ndarray, rank: np.ndarray, copies: np.ndarray, fields: list[Field], same: bool
) -> dict[int, int]:
    """Pairs (times their copies) of each pattern; a pattern is a number with a digit for each field."""
    radix = np.cumprod([1, *[f.digits for f in fields[:-1]]])
    out: dict[int, int] = {}
    for left, right in _steps(group, side, rank, same):
        code = np.zeros(len(left), dtype=np.int64)
        for f, r in zip(fields, radix, strict=True):
            code += f.patterns(left, right) * r
        names, at = np.unique(code, return_inverse=True)
        sums = np.zeros(len(names), dtype=np.int64)
        np.add.at(sums, at, copies[left] * copies[right])
        for k, v in zip(names.tolist(), sums.tolist(), strict=True):
            out[k] = out.get(k, 0) + v
    return out


def _dealt(left: DataFrame, right: DataFrame, keys: list[str], shown: list[Column], id_col: str, same: bool, tile_rows: int | None) -> tuple[DataFrame, int]:
    """Records dealt out by block: cell, keys, side, id and what is ``shown`` of them; and how many columns tell a cell."""
    l, r, on = split_cells(left, right, keys, id_col, same, tile_rows)
    tiled = len(on) > len(keys)
    if not same:
        rows = l.withColumn("_side", F.lit(0)).unionByName(r.withColumn("_side", F.lit(1)))
    elif tiled:  # a cell of one piece holds its rows once
        rows = l.withColumn("_side", F.when(F.col("_i") == F.col("_j"), ALONE).otherwise(0))
        rows = rows.unionByName(r.where("_i < _j").withColumn("_side", F.lit(1)))
    else:
        rows = l.withColumn("_side", F.lit(ALONE))
    cell = F.xxhash64(*on)  # cells whose hashes are equal are told apart by the key itself
    rows = rows.select(cell.alias("_cell"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(on)], "_side", F.col(id_col).alias("_id"), *shown)
    order = ["_cell", *[f"_k{i}" for i in range(len(on))], "_side", "_id"]
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "_cell").sortWithinPartitions(*order), 1 + len(on)


def _some_cells(batches: Iterator[pa.RecordBatch], keyed: int) -> Iterator[tuple]:
    """Whole cells of sorted records, some at a time: group, side, rank of the id, ids and the further columns."""
    held: list[tuple] = []

    def taken() -> tuple:
        group, at = np.zeros(len(held), dtype=np.int64), 0
        for k in range(1, len(held)):
            at += held[k][:keyed] != held[k - 1][:keyed]
            group[k] = at
        side, ids, *fields = zip(*(h[keyed:] for h in held), strict=True)
        rank = np.empty(len(held), dtype=np.int64)
        rank[sorted(range(len(held)), key=ids.__getitem__)] = np.arange(len(held))
        return group, np.array(side), rank, ids, fields

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(held) >= ROWS_AT_ONCE and row[:keyed] != held[-1][:keyed]:
                yield taken()
                held.clear()
            held.append(row)
    if held:
        yield taken()


def _texts_of(comparisons: list[Comparison]) -> list[Column]:
    return [F.col(c.column).cast("string").alias(f"_f{k}") for k, c in enumerate(comparisons)]


def block_patterns(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    comparisons: list[Comparison],
    id_col: str,
    same: bool,
    tile_rows: int,
    rare: list[str] | None = None,
) -> DataFrame:
    """gamma_* and n: pairs of records with equal ``keys`` per pattern, from records with ``copies``.

    ``rare`` names fields with a column ``tf_<field>`` that depends on the field's value: pairs equal in the field are also told
    apart by it, and the result has it, missing for other pairs.
    """
    rare = rare or []
    shown = [F.col("copies"), *_texts_of(comparisons), *[F.col(f"tf_{c}") for c in rare]]
    dealt, keyed = _dealt(left, right, keys, shown, id_col, same, tile_rows)
    names = [f"gamma_{c.name}" for c in comparisons] + [f"tf_{c}" for c in rare]
    n = len(comparisons)
    kinds = [T.IntegerType()] * n + [T.DoubleType()] * len(rare)
    schema = T.StructType([*[T.StructField(x, t) for x, t in zip(names, kinds, strict=True)], T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, int] = {}
        for group, side, rank, _, (copies, *columns) in _some_cells(batches, keyed):
            known = dict(zip(rare, columns[n:], strict=True))
            made = [Field(c, list(f), known.get(c.column)) for c, f in zip(comparisons, columns[:n], strict=True)]
            found = count_patterns(group, side, rank, np.array(copies, dtype=np.int64), made, same)
            for code, v in found.items():
                digits = []
                for f in made:
                    digits.append(code % f.digits - 1)
                    code //= f.digits
                by = {f.comparison.column: f.rare[d - f.top] if d >= f.top else None for f, d in zip(made, digits, strict=True)}
                pattern = (*(min(d, f.top) for f, d in zip(made, digits, strict=True)), *(by[c] for c in rare))
                counts[pattern] = counts.get(pattern, 0) + v
        out = [list(x) for x in zip(*counts, strict=True)] if counts else [[] for _ in names]
        arrays = [pa.array(o, pa.int32() if k < n else pa.float64()) for k, o in enumerate(out)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(counts.values()), pa.int64())], names=schema.names)

    return dealt.mapInArrow(run, schema).groupBy(*names).agg(F.sum("n").alias("n"))


def rare_exact(comparisons: list[Comparison]) -> list[str] | None:
    """Fields whose exact level has a term-frequency weight by the field itself; None if another level or column has one."""
    found = [(i, l, c) for c in comparisons for i, l in enumerate(c.scored) if l.tf_column]
    return [c.column for _, _, c in found] if all(i == 0 and l.tf_column == c.column for i, l, c in found) else None


def block_reaching(
    left: DataFrame, right: DataFrame, keys: list[str], comparisons: list[Comparison], needed: float, id_col: str, same: bool, tile_rows: int | None
) -> DataFrame:
    """Ids of the pairs of records with equal ``keys`` that gain ``needed``, from records with ``tf_*`` and ids of their own.

    A field is looked at only for pairs that the best levels of it and all later fields can still bring there, fields whose levels stand
    in a table first. Comparisons must be :func:`can_tabulate`, with term frequencies as :func:`rare_exact` asks for.
    """
    rare = rare_exact(comparisons)
    dealt, keyed = _dealt(left, right, keys, [*_texts_of(comparisons), *[F.col(f"tf_{c}") for c in rare]], id_col, same, tile_rows)
    n = len(comparisons)
    # index -1, a missing side, is the last entry and adds nothing
    weights = [np.array([*(math.log2(l.m / l.u) for l in reversed(c.scored)), 0.0]) for c in comparisons]
    kind = left.schema[id_col].dataType
    schema = T.StructType([T.StructField(f"{id_col}_{s}", kind) for s in ("l", "r")])

    def extra(field: Field) -> np.ndarray:
        """Term-frequency weight of the exact level, by the place of the frequency."""
        exact = field.comparison.scored[0]
        return np.array([exact.tf_weight * math.log2(exact.u / x) if x else 0.0 for x in field.rare])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, side, rank, ids, columns in _some_cells(batches, keyed):
            known = dict(zip(rare, columns[n:], strict=True))
            made = [Field(c, list(f), known.get(c.column)) for c, f in zip(comparisons, columns[:n], strict=True)]
            gains = [np.concatenate(([0.0], w[:-2], w[-2] + extra(f))) for w, f in zip(weights, made, strict=True)]
            order = sorted(range(n), key=lambda k: (made[k].table is None and made[k].texts is not None, -gains[k].max()))
            best = [sum(max(gains[k].max(), 0.0) for k in order[at + 1 :]) for at in range(n)]
            for l, r in _steps(group, side, rank, same):
                got = np.zeros(len(l))
                for at, k in enumerate(order):
                    got += gains[k][made[k].patterns(l, r)]
                    fine = np.flatnonzero(got + best[at] >= needed - 1e-6)
                    l, r, got = l[fine], r[fine], got[fine]
                if len(l):
                    yield pa.RecordBatch.from_pydict({f"{id_col}_{s}": [ids[x] for x in side_] for s, side_ in (("l", l.tolist()), ("r", r.tolist()))}, schema=to_arrow)

    to_arrow = to_arrow_schema(schema)
    return dealt.mapInArrow(run, schema)
