"""Global positions and running totals without a window over the whole table."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage, unstage

# a partition with more than so many times its share of the rows, and than so many rows, is cut anew
UNEVEN, LEAST_ROWS = 2, 10_000
_ROW_BITS = 33  # fixed value: Spark's monotonically_increasing_id keeps the row in the low 33 bits


def add_row_id(
    df: DataFrame, order: list[str], start: int = 1, out: str = "unique_id", partitions: int | None = None
) -> DataFrame:
    """Dense ids ``start, start+1, ...`` in the order of ``order``.

    Rows are range-partitioned over all order columns and sorted inside their partition; each
    partition counts its rows, and the running sum of those counts (one row per partition) shifts
    the local positions. A repeated leading value is split by the later order columns. Where rows that
    are equal in all of them make a partition larger than its share, ranges are cut anew with the place in the
    table written first as a last order column, so equal rows spread too and keep their order.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed, counts = _placed(df, n, order)
    if max(counts.values(), default=0) > max(UNEVEN * sum(counts.values()) / n, LEAST_ROWS):
        # the written table gives every row the same place each time it is read
        first = placed.withColumnRenamed("_at", "_tie").drop("_slice")
        again, counts = _placed(first, n, [*order, "_tie"])
        unstage(placed)
        placed = again
    low = (1 << _ROW_BITS) - 1
    sums = dict(zip(sorted(counts), accumulate((counts[k] for k in sorted(counts)), initial=0), strict=False))
    before = df.sparkSession.createDataFrame(list(sums.items()), "_slice long, _before long")
    return placed.join(F.broadcast(before), "_slice").select(
        *df.columns, (F.col("_before") + F.col("_at").bitwiseAND(low) + start).cast("long").alias(out)
    )


def _placed(df: DataFrame, n: int, order: list[str]) -> tuple[DataFrame, dict[int, int]]:
    """Rows in ranges of ``order`` as a table with their place, and how many each range has (one number a partition)."""
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = stage(rows.withColumn("_at", F.monotonically_increasing_id()), "rowid")
    sliced = placed.withColumn("_slice", F.shiftright("_at", _ROW_BITS))
    sliced._staged_at = placed._staged_at
    counts = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n")).collect()
    return sliced, {r["_slice"]: r["_n"] for r in counts}


def dense_positions(df: DataFrame, key: str, out: str = "position") -> DataFrame:
    """Distinct non-null values of ``key`` with their 1-based position in sorted order."""
    values = df.select(key).where(F.col(key).isNotNull()).distinct()
    return add_row_id(values, [key], start=1, out=out)


def running_totals(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Adds running sums in the order of ``order``, whose values must be distinct.

    Rows are range-partitioned and written once; sums run inside a range and are shifted by the totals of the
    ranges before it (one row for each range).
    """
    key = F.col(order).desc() if descending else F.col(order).asc()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, key).withColumn("_slice", F.spark_partition_id())
    data = stage(placed, "running")
    totals = data.groupBy("_slice").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    w = Window.orderBy("_slice")
    before = totals.select(
        "_slice", *[(F.sum(f"_t_{o}").over(w) - F.col(f"_t_{o}")).alias(f"_b_{o}") for o in sums]
    )
    inside = Window.partitionBy("_slice").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return data.join(F.broadcast(before), "_slice").select(
        *df.columns, *[(F.sum(c).over(inside) + F.col(f"_b_{o}")).alias(o) for o, c in sums.items()]
    )


def head(df: DataFrame, order: list, n: int) -> DataFrame:
    """First ``n`` rows in a stated order (a top-n plan, not a full sort)."""
    return df.orderBy(*order).limit(n)


def row_slices(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Adds ``slice_no``: consecutive groups of ``size`` rows in a stated order."""
    ids = add_row_id(df, order, start=0, out="_row")
    return ids.withColumn("slice_no", F.floor(F.col("_row") / size).cast("long")).drop("_row")
