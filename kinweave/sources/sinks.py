"""Writing tables: files, the catalog and databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .tables import CSV_OPTIONS, read_csv


def write_result(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """A result as CSV (with a header) or Parquet, one file per partition. CSV writes a null as an empty field."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.options(**CSV_OPTIONS, emptyValue="").csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def write_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    mode: str = "overwrite",
    properties: dict | None = None,
    connections: int = 8,
) -> None:
    """Load a database table; at most ``connections`` partitions write at the same time."""
    options = {"url": url, "dbtable": table, "numPartitions": str(connections), **(properties or {})}
    df.write.format("jdbc").options(**options).mode(mode).save()


def save_table(
    df: DataFrame,
    name: str,
    schema: T.StructType | None = None,
    mode: str = "overwrite",
    path: str | None = None,
) -> None:
    """Create or replace a catalog table with stated types, or append to it.

    With ``path`` the table's files lie there instead of in the warehouse folder.
    """
    typed = df.to(schema) if schema else df
    writer = typed.write.mode(mode)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def insert_into(df: DataFrame, name: str) -> None:
    """Append by column name to a table that exists, with its types."""
    df.to(df.sparkSession.table(name).schema).write.insertInto(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def csv_to_parquet(
    spark: SparkSession, source: str, target: str, schema: T.StructType, mode: str = "overwrite", multiline: bool | None = None
) -> None:
    """CSV to snappy Parquet under one fixed schema, ``multiline`` as for :func:`read_table`."""
    rows = read_csv(spark, source, schema, multiline)
    rows.write.mode(mode).option("compression", "snappy").parquet(target)
