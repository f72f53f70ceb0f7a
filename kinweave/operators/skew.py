"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import is_small, stage

# A value holding at least this share of the rows is "hot"; there are at most 1/share such values.
HOT_SHARE = 1e-4


def left_join_unique(
    big: DataFrame, lookup: DataFrame, keys: list[str], counts: DataFrame | None = None
) -> DataFrame:
    """``big`` left join ``lookup`` (at most one row per key) without one task taking a hot key.

    A lookup shown to be small is broadcast. Otherwise its rows for hot keys (at most 1/HOT_SHARE of
    them, so their broadcast is bounded) are attached first, and only the other rows are shuffled;
    rows already served carry a random-looking salt so they spread over all partitions.
    ``counts`` may give (keys, n) of ``big`` where the caller knows it.
    """
    if is_small(lookup):
        return big.join(F.broadcast(lookup), keys, "left")
    extra = [c for c in lookup.columns if c not in keys]
    tally = counts if counts is not None else big.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    tally = stage(tally.select(*keys, "n"), "tally")
    total = tally.agg(F.sum("n")).first()[0] or 0
    hot_keys = tally.where(F.col("n") >= max(total * HOT_SHARE, 1)).select(*keys)
    hot = lookup.join(F.broadcast(hot_keys), keys, "left_semi")
    hot = hot.withColumnsRenamed({c: f"_hot_{c}" for c in extra}).withColumn("_served", F.lit(True))
    cold = lookup.withColumn("_salt", F.lit(0))
    salted = big.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt",
        F.when(F.col("_served"), F.xxhash64(*big.columns, F.monotonically_increasing_id()))
        .otherwise(F.lit(0))
        .cast("long"),
    )
    # a served row has no partner under its salt; an unserved row meets the lookup under salt 0
    joined = salted.join(cold.withColumn("_salt", F.col("_salt").cast("long")), keys + ["_salt"], "left")
    return joined.select(
        *big.columns,
        *[F.when(F.col("_served"), F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in extra],
    )
