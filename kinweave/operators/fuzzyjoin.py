"""Joins on closeness — edit distance and cosine — through exact equi-join keys, with no loss."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import dot, unit
from ..session import stage
from .candidates import MOST_PIECES, TILE_ROWS, by_size, join_block, large_keys, split_cells

# ---- edit distance ------------------------------------------------------------------------------
#
# A text of length L is cut into d+1 even segments. Within edit distance d at least one segment
# survives unchanged in the other text, at a place that is bounded by the number of edits before and
# after it (partition-based similarity join, Li et al. 2011). Segments are the join keys.


def _segment(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """0-based start and size of segment ``i``; the later segments take the remainder."""
    base = F.floor(length / parts).cast("int")
    plain = parts - length % parts
    start = i * base + F.greatest(F.lit(0), i - plain)
    size = base + F.when(i >= plain, 1).otherwise(0)
    return start.cast("int"), size.cast("int")


def _key(length: Column, i: Column, text: Column) -> Column:
    return F.concat_ws(":", length.cast("string"), i.cast("string"), text)


def segment_keys(col: Column, distance: int) -> Column:
    """The keys of a text that others are looked up by: one per segment."""
    length = F.length(col)

    def one(i: Column) -> Column:
        start, size = _segment(length, i, distance + 1)
        return _key(length, i, F.substr(col, start + 1, size))

    return F.transform(F.sequence(F.lit(0), F.lit(distance)), one)


def probe_keys(col: Column, distance: int) -> Column:
    """The keys a text looks up: every piece of it that may equal a segment of a close text."""
    own = F.length(col)
    none = F.array().cast("array<string>")

    def for_length(length: Column) -> Column:
        shift = own - length

        def for_segment(i: Column) -> Column:
            start, size = _segment(length, i, distance + 1)
            left = distance - i
            lo = F.greatest(F.lit(0), start - i, start + shift - left).cast("int")
            hi = F.least(own - size, start + i, start + shift + left).cast("int")
            return F.when(
                lo <= hi,
                F.transform(F.sequence(lo, hi), lambda p: _key(length, i, F.substr(col, p + 1, size))),
            ).otherwise(none)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(distance)), for_segment))

    lengths = F.sequence(F.greatest(F.lit(0), own - distance), own + distance)
    return F.array_distinct(F.flatten(F.transform(lengths, for_length)))


def edit_join(
    left: DataFrame, right: DataFrame, col: str, id_col: str, distance: int, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """All (left, right) rows whose ``col`` lie within ``distance`` edits, with ``edits``; each pair once.

    A key shared by very many rows is tiled like any other block.
    """
    l = stage(left.select(id_col, col, F.explode(probe_keys(F.col(col), distance)).alias("_key")), "probes")
    r = stage(right.select(id_col, col, F.explode(segment_keys(F.col(col), distance)).alias("_key")), "segments")
    met = join_block(l, r, ["_key"], id_col, False, tile_rows)
    edits = F.levenshtein(F.col(f"{col}_l"), F.col(f"{col}_r"), distance)
    return (
        met.select(f"{id_col}_l", f"{id_col}_r", f"{col}_l", f"{col}_r", edits.alias("edits"))
        .where(F.col("edits").between(0, distance))
        .distinct()
    )


# ---- cosine -------------------------------------------------------------------------------------

#: Groups with more records than this are compared by matrix products.
MATRIX_ROWS = 256
#: A tile has at least so many vectors and at most so many bytes of them, and a product at most so many entries.
LEAST_TILE, TILE_BYTES, ENTRIES = 2_000, 16 << 20, 1 << 22


def cosine_join(
    left: DataFrame,
    right: DataFrame,
    vec: str,
    id_col: str,
    threshold: float,
    keys: list[str] | None = None,
    same: bool = False,
    pivots: int = 32,
    tile_rows: int | None = None,
    best: bool = False,
) -> DataFrame:
    """Pairs with cosine at least ``threshold``, as (id_l, id_r, cosine).

    Each right vector belongs to its nearest pivot. By the triangle inequality on angles a left
    vector need only meet a pivot's group if the group's angle range comes within arccos(threshold)
    of its own angle, and if the pivot is not further than twice that from its own nearest pivot; so
    groups are skipped without losing a pair. Where their tiles would take more copies of the vectors than plain tiles do, groups
    are left out. ``keys`` add plain equality. Big groups are tiled and compared by matrix products, with ``same`` and no pivots each
    two tiles once; with ``best`` only the best partner of each left vector leaves a tile (the least id among equal ones).
    """
    keys = keys or []
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-9

    def prepared(df: DataFrame) -> DataFrame:
        return df.select(id_col, *keys, unit(F.col(vec)).alias(vec)).where(F.col(vec).isNotNull())

    r = stage(prepared(right), "units")
    l = r if same else prepared(left)
    tile_rows = tile_rows or _tile_rows(r, vec)
    if not keys and r.count() <= tile_rows:  # groups could not spare a copy
        alone = [t.withColumn("_pivot", F.lit(0)) for t in (l, r)]
        return _matrix_pairs(*alone, ["_pivot"], vec, id_col, threshold, same, tile_rows, best)
    # a bounded number of vectors, chosen by hash, serves as pivots
    chosen = r.orderBy(F.xxhash64(id_col)).limit(pivots).select(vec).collect()
    if not chosen:
        ids = [F.col(id_col).alias(f"{id_col}_{s}") for s in ("l", "r")]
        return right.limit(0).select(*ids, F.lit(0.0).alias("cosine"))
    points = np.array([row[0] for row in chosen], dtype=np.float64)

    @F.pandas_udf(T.StructType([T.StructField("p", T.IntegerType()), T.StructField("a", T.DoubleType())]))
    def home(v: pd.Series) -> pd.DataFrame:
        angle = np.arccos(np.clip(np.stack(v.to_numpy()).astype(np.float64) @ points.T, -1.0, 1.0))
        nearest = angle.argmin(axis=1)
        return pd.DataFrame({"p": nearest.astype("int32"), "a": angle[np.arange(len(angle)), nearest]})

    r = stage(r.withColumn("_home", home(vec)), "homes")
    spans = (
        r.groupBy(F.col("_home.p").alias("p"))
        .agg(F.min("_home.a").alias("lo"), F.max("_home.a").alias("hi"))
        .collect()
    )
    low = np.full(len(points), np.inf)
    high = np.full(len(points), -np.inf)
    for row in spans:
        low[row["p"]], high[row["p"]] = row["lo"], row["hi"]

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def visits(v: pd.Series) -> pd.Series:
        angle = np.arccos(np.clip(np.stack(v.to_numpy()).astype(np.float64) @ points.T, -1.0, 1.0))
        near = angle <= angle.min(axis=1, keepdims=True) + 2 * reach
        inside = (angle + reach >= low) & (angle - reach <= high)
        return pd.Series([np.nonzero(row)[0].astype("int32") for row in near & inside])

    l = stage(l.withColumn("_visits", visits(vec)), "visits")
    on = [*keys, "_pivot"]
    plain = [t.select(id_col, *keys, vec, F.lit(0).alias("_pivot")) for t in (l, r)]
    grouped = [
        l.select(id_col, *keys, vec, F.explode("_visits").alias("_pivot")),
        r.select(id_col, *keys, vec, F.col("_home.p").alias("_pivot")),
    ]
    whole = _copies(*plain, on, same and not best, tile_rows) <= _copies(*grouped, on, False, tile_rows)
    l, r = plain if whole else grouped
    halves = same and not best and whole
    if not keys:
        return _matrix_pairs(l, r, on, vec, id_col, threshold, same, tile_rows, best, halves)
    # groups of many records become matrix products, the many small ones plain joins
    large = large_keys(l, r, on, False, MATRIX_ROWS)
    parts = []
    if large is not None:
        (large_l, l), (large_r, r) = by_size(l, large, on), by_size(r, large, on)
        parts.append(_matrix_pairs(large_l, large_r, on, vec, id_col, threshold, same, tile_rows, best, halves))
    pairs = join_block(l, r, on, id_col, False, None)
    if same:
        pairs = pairs.where(F.col(f"{id_col}_l") < F.col(f"{id_col}_r"))
    scored = pairs.select(
        f"{id_col}_l", f"{id_col}_r", dot(F.col(f"{vec}_l"), F.col(f"{vec}_r")).alias("cosine")
    )
    return reduce(DataFrame.unionAll, [scored.where(F.col("cosine") >= threshold), *parts])


def _tile_rows(df: DataFrame, vec: str) -> int:
    """Vectors of a tile: few enough to give all tasks a cell, many enough to spare copies, and bounded in bytes."""
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("size")).first()
    across = math.isqrt(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    return max(LEAST_TILE, min(-(-seen["n"] // across), TILE_BYTES // (8 * max(seen["size"] or 1, 1))))


def _copies(l: DataFrame, r: DataFrame, on: list[str], halves: bool, tile_rows: int) -> int:
    """How many vectors the cells of :func:`split_cells` take, over all groups."""
    a, b = (t.groupBy(*on).agg(F.count(F.lit(1)).alias(n)) for t, n in ((l, "_a"), (r, "_b")))

    def pieces(n: str) -> Column:
        return F.least(F.ceil(F.col(n) / tile_rows), F.lit(MOST_PIECES))

    taken = F.col("_a") * (pieces("_a") + 1) if halves else F.col("_a") * pieces("_b") + F.col("_b") * pieces("_a")
    return a.join(b, on).agg(F.sum(taken)).first()[0] or 0


def bounded_product(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray | None:
    """``a @ b`` of unit vectors, or None as soon as a first part shows that no entry reaches ``threshold``."""
    part = max(a.shape[1] // 4, 1)
    first = a[:, :part] @ b[:part]
    rest_a, rest_b = np.linalg.norm(a[:, part:], axis=1), np.linalg.norm(b[part:], axis=0)
    if (first + np.outer(rest_a, rest_b)).max(initial=-1.0) < threshold - 1e-9:
        return None
    return a @ b


def _matrix_pairs(
    l: DataFrame, r: DataFrame, on: list[str], vec: str, id_col: str, threshold: float, same: bool, tile_rows: int, best: bool,
    halves: bool = False,
) -> DataFrame:
    """The pairs of each group as one matrix product per cell; only close pairs become rows.

    A cell holds about ``tile_rows`` vectors per side, up to a group of ``MOST_PIECES`` tiles. With ``halves`` both sides are one table, and a cell
    of two tiles has the pairs in either direction, whose lower id is put left.
    """
    l, r, on = split_cells(l, r, on, id_col, halves, tile_rows)
    turned = halves and "_i" in on
    left_id, right_id = f"{id_col}_l", f"{id_col}_r"
    id_type = l.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField(left_id, id_type),
            T.StructField(right_id, r.schema[id_col].dataType),
            T.StructField("cosine", T.DoubleType()),
        ]
    )

    def multiply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({left_id: a[left_id][:0], right_id: b[right_id][:0], "cosine": np.zeros(0)})
        if best:  # the first of equal maxima is the one with the least id
            b = b.sort_values(right_id, ignore_index=True)
        ids_a, ids_b = a[left_id].to_numpy(), b[right_id].to_numpy()
        right_side = np.stack(b[f"{vec}_r"].to_numpy()).astype(np.float64).T
        parts = []
        across = turned and a["_i_l"].iloc[0] != a["_j_l"].iloc[0]
        step = max(1, min(512, ENTRIES // len(b)))
        for at in range(0, len(a), step):
            some = ids_a[at : at + step]
            left_side = np.stack(a[f"{vec}_l"].to_numpy()[at : at + step]).astype(np.float64)
            product = bounded_product(left_side, right_side, threshold)
            if product is None:
                continue
            if best:
                y = product.argmax(axis=1)
                x = np.flatnonzero(product[np.arange(len(y)), y] >= threshold)
                y = y[x]
            else:
                x, y = np.nonzero(product >= threshold)
            one, other = some[x], ids_b[y]
            if across:  # equal ids are in one tile
                one, other = np.where(one < other, one, other), np.where(one < other, other, one)
            found = pd.DataFrame({left_id: one, right_id: other, "cosine": product[x, y]})
            parts.append(found[(one < other).astype(bool)] if same else found)
        if not parts:
            return pd.DataFrame({left_id: ids_a[:0], right_id: ids_b[:0], "cosine": np.zeros(0)})
        return pd.concat(parts, ignore_index=True)

    left_groups = _side(l, "l").groupBy(*[f"{k}_l" for k in on])
    right_groups = _side(r, "r").groupBy(*[f"{k}_r" for k in on])
    return left_groups.cogroup(right_groups).applyInPandas(multiply, schema)


def _side(df: DataFrame, suffix: str) -> DataFrame:
    """Fresh columns per side, so that a table can be grouped with itself."""
    return df.select(*[F.col(c).alias(f"{c}_{suffix}") for c in df.columns])
