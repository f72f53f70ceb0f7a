"""Exact top-k by inner product: columnar branch-and-bound over blocks of dimensions.

Vectors are whole numbers, floor(scale times each component). A task turns each batch of candidates into a vertical layout, one
row a dimension, ordered by the mass the queries have in them. Scores are accumulated block by block of dimensions. After each
block a candidate stays only if its partial score plus the product of the masses that remain on both sides (by Cauchy and
Schwarz the most the rest can add) reaches the query's k-th best score so far; survivors are compacted before the next block
of dimensions is read. The first bound of a query comes from the other queries of its block, which are candidates as well.

Queries are taken in blocks of a bounded number of values, each of which is broadcast and meets all candidates once: a task
keeps its k best of each query and sends only those. Nothing is paired by a join. All sums are exact: doubles where the
norms show that no partial sum leaves 2**53, else Python's integers.

Decisions: a vector that is null or holds a null, an infinity or no number takes no part. Components beyond a vector's length
count as zero; an empty vector scores 0. Each row is a query or candidate of its own, repeated rows too; only the query's own row
is left out. Ties go to the smaller id, a null id last (2**63 - 1 counts as null). A row with a null id is no query. Components
and scores beyond 64 bits are cut to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import add_row_id
from ..session import stage
from .common import arrow_rows, arrow_schema, as_batch, release_memory, shuffle_partitions

TOP = 5
SCALE = 256
#: Dimensions accumulated between two prunings.
BLOCK_DIMENSIONS = 8
#: Values (queries times dimensions) of one block of queries: 16 MB as doubles.
BLOCK_VALUES = 1 << 21
#: Rows of one batch of candidates, and queries whose first block of dimensions is accumulated at once.
CANDIDATES, QUERIES_AT_ONCE = 8_192, 128

_NO_ID = np.int64((1 << 63) - 1)
_EXACT = float(1 << 53)


def whole_numbers(vectors: DataFrame, column: str = "embedding", id_col: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """vec_id, v (whole numbers) and row (a number of its own) of the vectors that take part; written once."""
    x = F.col(column)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    own = vectors.where(x.isNotNull() & F.coalesce(finite, F.lit(False)))
    made = own.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    # every row meets all queries, so the work is dealt out by rows, however small the file
    dealt = made.repartition(shuffle_partitions(vectors.sparkSession))
    return stage(dealt.withColumn("row", F.monotonically_increasing_id()), "vectors")


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of an Arrow list column as a matrix of whole numbers, short rows filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(int(sizes.max(initial=0)), width or 0)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k highest scores, ties to the smaller id, then to the earlier row."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = scores >= least
        scores, ids, rows = scores[some], ids[some], rows[some]
    order = np.lexsort((rows, ids, -scores))[:k]
    return scores[order], ids[order], rows[order]


class QueryBlock:
    """A block of queries with the order of its dimensions, its remaining masses and its first bounds."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, values: np.ndarray, k: int):
        self.ids, self.rows, self.k = ids, rows, k
        self.exact = values
        self.order = np.argsort(-np.square(values.astype(np.float64)).sum(axis=0), kind="stable")
        self.values = values[:, self.order].astype(np.float64)
        self.steps = list(range(0, max(values.shape[1], 1), BLOCK_DIMENSIONS))
        self.rest = remaining(self.values.T, self.steps)
        self.norm = float(np.sqrt(np.square(self.values).sum(axis=1)).max(initial=0.0))
        self.floor = np.full(len(ids), -np.inf)
        if self.norm**2 < _EXACT / 4 and len(ids) > k:
            for low in range(0, len(ids), QUERIES_AT_ONCE):
                part = self.values[low : low + QUERIES_AT_ONCE]
                scores = part @ self.values.T
                scores[np.arange(len(part)), low + np.arange(len(part))] = -np.inf  # the query's own row
                self.floor[low : low + len(part)] = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]


def remaining(vertical: np.ndarray, steps: list[int]) -> np.ndarray:
    """For each block of dimensions the length of each vector's part beyond it (vertical: one row a dimension)."""
    square = np.square(vertical)
    ends = [*steps[1:], len(vertical)]
    return np.array([np.sqrt(square[e:].sum(axis=0)) for e in ends])


class Search:
    """The k best candidates of each query of a block, over the batches of a task."""

    def __init__(self, block: QueryBlock):
        self.block = block
        m = len(block.ids)
        none = np.zeros(0, dtype=np.int64)
        self.found = [(none, none, none) for _ in range(m)]
        self.bound = block.floor.copy()
        self.compared = self.accumulated = 0  # pairs, and pairs times dimensions that were accumulated

    def offer(self, ids: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
        block = self.block
        width = block.exact.shape[1]
        # what a candidate has in dimensions that no query has adds nothing
        own = values[:, :width] if values.shape[1] >= width else np.pad(values, ((0, 0), (0, width - values.shape[1])))
        norm = float(np.sqrt(np.square(own.astype(np.float64)).sum(axis=1)).max(initial=0.0))
        if norm * block.norm >= _EXACT / 4:
            self._offer_large(ids, rows, own)
            return
        vertical = np.ascontiguousarray(own[:, block.order].T.astype(np.float64))
        rest = remaining(vertical, block.steps)
        ends = [*block.steps[1:], width]
        for low in range(0, len(block.ids), QUERIES_AT_ONCE):
            some = slice(low, low + QUERIES_AT_ONCE)
            first = block.values[some, : ends[0]] @ vertical[: ends[0]]
            self.compared += first.size
            self.accumulated += first.size * ends[0]
            for i, partial in enumerate(first, start=low):
                self._one(i, partial, vertical, rest, ends, ids, rows)

    def _one(self, i, partial, vertical, rest, ends, ids, rows) -> None:
        block = self.block
        alive = np.flatnonzero(rows != block.rows[i])
        partial = partial[alive]
        for step, end in enumerate(ends):
            if step:
                begin = block.steps[step]
                part = vertical[begin:end]
                part = part if len(alive) == vertical.shape[1] else part[:, alive]
                partial = partial + block.values[i, begin:end] @ part
                self.accumulated += len(alive) * (end - begin)
            # the slack covers the rounding of the masses; the sums themselves are exact
            most = partial + block.rest[step, i] * rest[step, alive] * (1 + 1e-9) + 0.5
            stays = most >= self.bound[i]
            if not stays.all():
                alive, partial = alive[stays], partial[stays]
            if not len(alive):
                return
        self._keep(i, partial.astype(np.int64), ids[alive], rows[alive])

    def _keep(self, i, scores, ids, rows) -> None:
        k = self.block.k
        old = self.found[i]
        self.found[i] = _best(*(np.concatenate(x) for x in zip(old, (scores, ids, rows), strict=True)), k)
        if len(self.found[i][0]) == k:
            self.bound[i] = max(self.bound[i], self.found[i][0][-1])

    def _offer_large(self, ids, rows, own) -> None:
        """Sums that may leave the doubles' whole numbers: Python's integers, without pruning."""
        values = own.astype(object)
        for i, query in enumerate(self.block.exact.astype(object)):
            others = np.flatnonzero(rows != self.block.rows[i])
            scores = (values[others] * query).sum(axis=1) if len(query) else np.zeros(len(others), dtype=object)
            cut = np.array([min(max(int(s), -(1 << 63) + 1), (1 << 63) - 1) for s in scores], dtype=np.int64)
            self._keep(i, cut, ids[others], rows[others])

    def result(self) -> dict:
        n = [len(s) for s, _, _ in self.found]
        joined = [np.concatenate([f[j] for f in self.found]) if n else np.zeros(0, dtype=np.int64) for j in range(3)]
        return {
            "query_row": pa.array(np.repeat(self.block.rows, n)),
            "query_id": pa.array(np.repeat(self.block.ids, n)),
            "vec_id": pa.array(joined[1], mask=joined[1] == _NO_ID),
            "row": pa.array(joined[2]),
            "score": pa.array(joined[0]),
        }


def _meet(candidates: DataFrame, block: QueryBlock) -> DataFrame:
    """The k best of each query among the candidates of each task."""
    shared = candidates.sparkSession.sparkContext.broadcast(block)
    schema = "query_row long, query_id long, vec_id long, row long, score long"
    fields = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(shared.value)
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).fill_null(int(_NO_ID)).to_numpy(zero_copy_only=False)
                search.offer(ids, batch.column(2).to_numpy(), matrix(batch.column(1)))
        yield as_batch(search.result(), fields)
        release_memory()

    return candidates.select("vec_id", "v", "row").mapInArrow(run, schema)


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, block_values: int = BLOCK_VALUES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` best rows for each query (all, if fewer).

    ``vectors`` comes from :func:`whole_numbers`; ``is_query`` is a condition on its ``vec_id``.
    """
    spark = vectors.sparkSession
    chosen = vectors.where(is_query & F.col("vec_id").isNotNull())
    width = chosen.agg(F.max(F.size("v")).alias("w")).first()["w"] or 1
    queries = add_row_id(chosen, ["vec_id", "row"], start=0, out="place")
    total = chosen.count()
    per_block = max(block_values // width, 1)
    parts = []
    with arrow_rows(spark, CANDIDATES):
        for low in range(0, total, per_block):
            # at most block_values values come to the driver and go out again
            held = queries.where(F.col("place").between(low, low + per_block - 1)).select("vec_id", "v", "row").toArrow()
            held = held.combine_chunks().to_batches()[0]
            block = QueryBlock(held.column(0).to_numpy(), held.column(2).to_numpy(), matrix(held.column(1), width), k)
            parts.append(stage(_meet(vectors, block), "best"))
    if not parts:
        return vectors.where("false").select(
            F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("row").alias("score")
        )
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
