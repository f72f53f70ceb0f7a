"""Column selection, renaming and row filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small


def select_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols)


def rename_columns(df: DataFrame, mapping: dict[str, str] | list[str]) -> DataFrame:
    """Rename by mapping, or all columns at once by a list of equal length."""
    if isinstance(mapping, dict):
        return df.withColumnsRenamed(mapping)
    return with_positional_schema(df, mapping)


def with_positional_schema(df: DataFrame, cols: list[str]) -> DataFrame:
    if len(cols) != len(df.columns):
        raise ValueError(f"{len(cols)} names for {len(df.columns)} columns")
    return df.toDF(*cols)


def lowercase_headers(df: DataFrame) -> DataFrame:
    lowered = [c.lower() for c in df.columns]
    if len(set(lowered)) != len(lowered):
        raise ValueError("two headers differ only by case")
    return df.toDF(*lowered)


def standardise_headers(df: DataFrame, aliases: dict[str, str], canonical: list[str]) -> DataFrame:
    """Keep canonical columns and rename known variants to them; other columns go."""
    kept: dict[str, Column] = {}
    for c in df.columns:
        name = c if c in canonical else aliases.get(c)
        if name and name not in kept:
            kept[name] = F.col(c).alias(name)
    return df.select(*kept.values())


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def where_equals(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(F.col(col) == F.lit(value))


def _same(df: DataFrame, values: DataFrame, cols: list[str], value_cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [df[c] == values[v] for c, v in zip(cols, value_cols)])


def in_set(df: DataFrame, values: DataFrame, cols: list[str], value_cols: list[str]) -> DataFrame:
    """Rows whose value occurs in a list."""
    keys = broadcast_if_small(values.select(*value_cols).distinct())
    return df.join(keys, _same(df, keys, cols, value_cols), "left_semi")


def not_in_set(df: DataFrame, values: DataFrame, cols: list[str], value_cols: list[str]) -> DataFrame:
    """Rows whose value does not occur in a list; a null value never occurs in it."""
    keys = broadcast_if_small(values.select(*value_cols).distinct())
    return df.join(keys, _same(df, keys, cols, value_cols), "left_anti")


def flag_where(df: DataFrame, condition: Column, out: str) -> DataFrame:
    return df.withColumn(out, F.when(condition, 1).otherwise(0))


def flagged_only(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose 0/1 flag is 1 (predicted links, or true links)."""
    return df.where(F.col(flag) == 1)


def cast_string(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in cols})
