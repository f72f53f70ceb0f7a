"""Column profiles: nulls, frequencies, distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def _long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value) rows for the given columns, values as text."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "column_name", "value"
    )


def _per_column(df: DataFrame, cols: list[str], stat, dtype: str, out: str) -> DataFrame:
    one = df.agg(*[stat(F.col(c)).cast(dtype).alias(c) for c in cols])
    return one.unpivot([], cols, "column_name", out)


def missingness(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Share of nulls per column, in one pass."""
    return _per_column(
        df, cols or df.columns, lambda c: F.avg(c.isNull().cast("int")), "double", "null_share"
    )


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return _per_column(df, cols or df.columns, lambda c: F.count_if(c.isNull()), "long", "null_count")


def row_count(df: DataFrame, out: str = "rows") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(out))


def distinct_count(df: DataFrame, cols: list[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column; ``approximate`` trades exactness for a constant-size state."""
    if approximate:
        return _per_column(df, cols, F.approx_count_distinct, "long", "distinct_values")
    seen = _long(df, cols).where(F.col("value").isNotNull()).distinct()
    counted = seen.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_values"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    return names.join(counted, "column_name", "left").fillna(0, ["distinct_values"])


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Frequency of every non-null value of every column."""
    return (
        _long(df, cols)
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("value_count"))
    )


def value_occurrence(df: DataFrame, col: str) -> DataFrame:
    """How many values occur once, twice, ..."""
    once = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("occurrences"))
    return once.groupBy("occurrences").agg(F.count(F.lit(1)).alias("values"))


def profile_columns(
    df: DataFrame, cols: list[str], top_n: int = 10, bottom_n: int = 5
) -> DataFrame:
    """Most and least frequent values, ties by value: (column_name, part, place, value, value_count).

    The rank filter is pushed below the shuffle (each task forwards at most ``n`` rows per column).
    """
    counts = stage(value_counts(df, cols), "profile")

    def best(part: str, n: int, order) -> DataFrame:
        w = Window.partitionBy("column_name").orderBy(order, F.col("value").asc())
        return (
            counts.withColumn("place", F.row_number().over(w))
            .where(F.col("place") <= n)
            .select("column_name", F.lit(part).alias("part"), "place", "value", "value_count")
        )

    top = best("top", top_n, F.col("value_count").desc())
    return top.unionAll(best("bottom", bottom_n, F.col("value_count").asc()))


def frequency_percentiles(df: DataFrame, cols: list[str]) -> DataFrame:
    """For each frequency of a column, the share of rows held by values at least that frequent.

    The running sum goes over distinct frequencies, of which N rows can have at most about sqrt(2N).
    """
    freq = (
        value_counts(df, cols)
        .groupBy("column_name", "value_count")
        .agg((F.col("value_count") * F.count(F.lit(1))).alias("rows_held"))
    )
    w = Window.partitionBy("column_name")
    upto = w.orderBy(F.col("value_count").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return freq.select(
        "column_name",
        "value_count",
        "rows_held",
        (F.sum("rows_held").over(upto) / F.sum("rows_held").over(w)).alias("row_share"),
    )
