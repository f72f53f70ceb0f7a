"""Clusters of linked records: connected components by contraction inside partitions and star rounds between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage, stage_measured, unstage
from .skew import left_join_unique

# a node with more neighbours than this is attached through the skew-safe join
HUB_DEGREE = 1_000_000
# edges a task contracts at once, and how many at most one task may finish
CHUNK_EDGES = 1 << 19
LOCAL_EDGES = 1 << 18


def spanning_stars(u: pa.Array, v: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(node, least node of its component) of every node in the edges (u, v)."""
    names = pc.unique(pa.concat_arrays([u, v]))
    names = names.take(pc.sort_indices(names))
    a, b = (pc.index_in(x, value_set=names).to_numpy() for x in (u, v))
    root = np.arange(len(names))
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return names, names.take(pa.array(root))
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        least = np.minimum(x, y)
        # roots go below their least neighbour, then every node below its new root
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        while not np.array_equal(root, further := root[root]):
            root = further


def contract(edges: DataFrame, chunk: int = CHUNK_EDGES, roots: bool = False) -> DataFrame:
    """Edges (u, v) that join the same nodes: in each partition every node is tied to the least of its component there.

    No shuffle. A partition is taken in chunks of bounded size; with ``roots`` the least nodes come too, tied to themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def tied() -> pa.RecordBatch:
            u, v = (pa.concat_arrays([h.column(k) for h in held]) for k in (0, 1))
            node, least = spanning_stars(u, v)
            if not roots:
                moved = pc.not_equal(node, least)
                node, least = node.filter(moved), least.filter(moved)
            return pa.RecordBatch.from_arrays([node, least], names=["u", "v"])

        for batch in batches:
            if n and n + batch.num_rows > chunk:
                yield tied()
                held, n = [], 0
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if held:
            yield tied()

    return edges.mapInArrow(run, edges.schema)


def _with_least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds to each row (u, v) the least node ``m`` among u and all its neighbours; and the table that holds it."""
    least, seen = stage_measured(
        edges.groupBy("u").agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("n")),
        "least",
        degree=F.max("n"),
    )
    lookup = least.select("u", F.least("u", "_m").alias("m"))
    if (seen["degree"] or 0) > HUB_DEGREE:
        return left_join_unique(edges, lookup, ["u"], counts=least.select("u", "n")), least
    return edges.join(lookup, "u"), least


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u moves to the least node around u; as a table."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined, least = _with_least(both)
    moved = joined.where(F.col("v") > F.col("u"))
    out = stage(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
    unstage(least)
    return out


def _small_star(edges: DataFrame) -> tuple[DataFrame, dict]:
    """u and its lower neighbours all point at the least of them; as a table, contracted, with its mark."""
    joined, least = _with_least(edges)
    moved = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = _staged_edges(moved.unionAll(joined.select("u", F.col("m").alias("v"))).distinct())
    unstage(least)
    return out


def _staged_edges(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The contracted edges as a table, with a mark that tells two edge sets apart."""
    h = F.xxhash64("u", "v")
    return stage_measured(
        contract(edges), "edges", n=F.count(F.lit(1)), x=F.sum(h % 1_000_003), y=F.sum(F.shiftright(h, 20) % 1_000_033)
    )


def connected_components(pairs: DataFrame, left: str, right: str, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) for every node of the pair list; a component is named by its least node.

    Each partition is contracted to stars first, without a shuffle, so at most one edge a node and partition
    goes on. Once no more than ``local_edges`` are left (a counted bound) one task joins them. Until then, star rounds
    bring the stars of different partitions together: two aggregations and two joins over the edges each, their number growing
    with the logarithm of the size. Rounds are written to the checkpoint folder and older ones are deleted.
    """
    a, b = F.col(left), F.col(right)
    edges, mark = _staged_edges(
        pairs.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    )
    while mark["n"] > local_edges:
        wide = _large_star(edges)
        after, new_mark = _small_star(wide)
        unstage(edges)
        unstage(wide)
        edges = after
        if new_mark == mark:
            break
        mark = new_mark
    if mark["n"] <= local_edges:
        return contract(edges.coalesce(1), max(local_edges, 1), roots=True).toDF("node", "component")
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionAll(roots)


def join_components(known: DataFrame, pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Components (node, component) after more ``pairs``, from ``known`` ones, which are not worked out again.

    Only the names of the components that the pairs tie together are joined; other nodes keep theirs.
    """
    named = pairs.select(F.col(left).alias("a"), F.col(right).alias("b"))
    for side in ("a", "b"):
        lookup = known.select(F.col("node").alias(side), "component")
        named = left_join_unique(named, lookup, [side])
        named = named.withColumn(side, F.coalesce("component", side)).drop("component")
    # a node without a component so far stands for itself
    tied = stage(connected_components(named, "a", "b"), "tied")
    moved = left_join_unique(known, tied.select(F.col("node").alias("component"), F.col("component").alias("_to")), ["component"])
    moved = moved.select("node", F.coalesce("_to", "component").alias("component"))
    return moved.unionByName(tied.join(known.select("node"), "node", "left_anti"))


def cluster_pairs(
    records: DataFrame,
    pairs: DataFrame,
    id_col: str,
    threshold: float | None = 0.70,
    score: str = "match_probability",
    out: str = "cluster_id",
) -> DataFrame:
    """Every record with the least id of its cluster; unlinked records are clusters of their own."""
    kept = pairs if threshold is None else pairs.where(F.col(score) >= threshold)
    found = connected_components(kept.select(f"{id_col}_l", f"{id_col}_r"), f"{id_col}_l", f"{id_col}_r")
    joined = records.join(found, records[id_col] == found["node"], "left")
    return joined.select(
        *[records[c] for c in records.columns], F.coalesce(found["component"], records[id_col]).alias(out)
    )


def cluster_sizes(clusters: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    return clusters.groupBy(cluster).agg(F.count(F.lit(1)).alias("members"))


def cluster_size_distribution(clusters: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """How many clusters have each size."""
    return cluster_sizes(clusters, cluster).groupBy("members").agg(F.count(F.lit(1)).alias("clusters"))


def count_multi_clusters(clusters: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Number of clusters with at least two members."""
    many = cluster_sizes(clusters, cluster).where(F.col("members") >= 2)
    return many.agg(F.count(F.lit(1)).alias("multi_clusters"))
