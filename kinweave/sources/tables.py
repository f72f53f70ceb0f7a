"""Reading tables: files with a stated schema, and databases over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.projection import with_positional_schema
from ..schema import require_columns
from .splitcsv import read_split_csv

# standard CSV: a quote inside a field is doubled, blanks belong to the field
CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}

_FORMATS = {"csv": "csv", "txt": "csv", "parquet": "parquet", "json": "json", "jsonl": "json"}


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | None = None,
    exactly: bool = False,
    json_orient: str = "lines",
    multiline: bool | None = None,
) -> DataFrame:
    """One table from a file or folder. The format follows the suffix; an unknown suffix reads as CSV.

    CSV fields may hold line breaks; large files are split all the same, at line ends outside quoted fields. ``multiline=False``
    says that there are no such breaks, which saves a scan; ``multiline=True`` reads each file by one task, also
    where it does not keep to the standard. Column-oriented JSON has one document per line, with ``multiline`` one per file.

    With ``schema`` nothing is inferred and a missing column raises; ``exactly`` forbids further ones.
    CSV without a schema reads every field as text (no inference pass over the data).
    """
    kind = (fmt or _FORMATS.get(path.rstrip("/").rsplit(".", 1)[-1].lower(), "csv")).lower()
    if kind == "csv":
        found = spark.read.options(**CSV_OPTIONS, multiLine=multiline is not False).csv(path)
        if multiline is None:
            found = read_split_csv(spark, path, found.schema, CSV_OPTIONS)
    elif kind == "parquet":
        found = spark.read.parquet(path)
    elif kind == "json" and json_orient == "lines":
        found = spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    elif kind == "json" and json_orient == "columns":
        if schema is None:
            raise ValueError("column-oriented JSON needs a schema")
        found = json_columns(spark, path, schema, bool(multiline))
    else:
        raise ValueError(f"unknown format {kind} / {json_orient}")
    if schema is None:
        return found
    require_columns(found, schema.fieldNames(), exactly)
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def read_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType, multiline: bool | None = None) -> DataFrame:
    """CSV files under a stated schema, whose names must be those of the headers; ``multiline`` as for :func:`read_table`.

    Of files that are split at line breaks outside fields, the header of one is compared with the schema.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    options = CSV_OPTIONS | {"enforceSchema": False}
    if multiline is not None:
        return spark.read.schema(schema).options(**options, multiLine=multiline).csv(paths)
    named = spark.read.options(**CSV_OPTIONS, multiLine=True).csv(paths).columns
    if [n.lower() for n in named] != [n.lower() for n in schema.fieldNames()]:
        raise ValueError(f"the header has {named}, the schema {schema.fieldNames()}")
    return read_split_csv(spark, paths, schema, options)


def json_columns(
    spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False
) -> DataFrame:
    """Column-oriented JSON, ``{"column": {"row": value}}``: one document per line, or per file.

    Each document becomes one map per column, exploded and put together by row name.
    """
    text = spark.read.text(path, wholetext=multiline).select(
        F.input_file_name().alias("_file"),
        F.monotonically_increasing_id().alias("_doc"),
        F.from_json("value", "map<string,map<string,string>>").alias("m"),
    )
    cells = text.select("_file", "_doc", F.explode("m").alias("_name", "_rows")).select(
        "_file", "_doc", "_name", F.explode("_rows").alias("_row", "_value")
    )
    names = schema.fieldNames()
    rows = cells.groupBy("_file", "_doc", "_row").pivot("_name", names)
    rows = rows.agg(F.first("_value", ignorenulls=True))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    partitions: int = 16,
    properties: dict | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """A database table, read in parallel over ranges of a numeric column.

    The range comes from the column's minimum and maximum, which the database computes. Filters and
    column selections on the result are pushed to the database.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **(properties or {}))
    if partition_column:
        query = f"select min({partition_column}) as lo, max({partition_column}) as hi from {table}"
        lo, hi = (
            spark.read.format("jdbc").options(url=url, query=query, **(properties or {})).load().first()
        )
        if lo is not None:
            reader = reader.options(
                partitionColumn=partition_column,
                lowerBound=str(lo),
                upperBound=str(hi + 1),
                numPartitions=str(partitions),
            )
    found = reader.load()
    return with_positional_schema(found, columns) if columns else found


def read_jdbc_tables(spark: SparkSession, url: str, tables: str, **options) -> list[DataFrame]:
    """One table (de-duplicate) or two (link) from a comma-separated list of names."""
    names = [t.strip() for t in tables.split(",") if t.strip()]
    if len(names) not in (1, 2):
        raise ValueError(f"one or two tables expected, got {names}")
    return [read_jdbc(spark, url, n, **options) for n in names]
