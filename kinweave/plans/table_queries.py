"""Queries over sources, sinks, projections, cleaning, privacy and profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import privacy, text
from ..operators import ordering, profiling, projection
from ..session import checkpoint_root
from ..sources import sinks
from ..sources.tables import read_table
from ..streaming.convert import csv_folder_to_parquet
from .registry import query, table

# ---- sources and sinks --------------------------------------------------------------------------


def _scratch(spark, label: str) -> str:
    return f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


@query("read_csv", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def read_csv(spark, d):
    rows = table(spark, d, "supplier")
    path = _scratch(spark, "csv")
    sinks.write_result(rows, path)
    return read_table(spark, path, "csv", rows.schema, exactly=True)


@query("read_parquet", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def read_parquet(spark, d):
    return read_table(spark, f"{d}/customer.parquet")


@query("read_json_lines", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def read_json_lines(spark, d):
    rows = table(spark, d, "supplier")
    path = _scratch(spark, "json")
    rows.write.json(path)
    return read_table(spark, path, "json", rows.schema)


@query("read_json_columns", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def read_json_columns(spark, d):
    """Column-oriented documents of one nation and at most a thousand keys each, read back as rows."""
    rows = table(spark, d, "supplier")
    path = _scratch(spark, "json-columns")

    def column(c: str):
        return F.map_from_entries(
            F.collect_list(F.struct(F.col("s_suppkey").cast("string"), F.col(c).cast("string")))
        ).alias(c)

    names = ["s_suppkey", "s_name", "s_acctbal"]
    documents = rows.groupBy("s_nationkey", F.expr("s_suppkey div 1000")).agg(*[column(c) for c in names])
    documents.select(F.to_json(F.struct(*names))).write.text(path)
    schema = T.StructType([rows.schema[c] for c in names])
    return read_table(spark, path, "json", schema, json_orient="columns")


@query("positional_schema", "SELECT r_regionkey AS id, r_name AS name FROM region")
def positional_schema(spark, d):
    return projection.with_positional_schema(table(spark, d, "region"), ["id", "name"])


@query("save_table", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT), r_name FROM region")
def save_table(spark, d):
    """A typed table is replaced by one load and extended by a second."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    name = f"places_{uuid.uuid4().hex}"
    nation = table(spark, d, "nation").selectExpr("n_nationkey as id", "n_name as name")
    region = table(spark, d, "region").selectExpr("r_regionkey as id", "r_name as name")
    sinks.save_table(nation, name, schema, path=_scratch(spark, "table"))
    sinks.insert_into(region, name)
    return spark.table(name)


@query("csv_to_parquet", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_to_parquet(spark, d):
    rows = table(spark, d, "orders").drop("o_orderdate")
    source, target = _scratch(spark, "csv"), _scratch(spark, "parquet")
    sinks.write_result(rows, source)
    sinks.csv_to_parquet(spark, source, target, rows.schema)
    return spark.read.parquet(target)


@query("csv_to_parquet_chunks", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def csv_to_parquet_chunks(spark, d):
    rows = table(spark, d, "part")
    source, target = _scratch(spark, "csv"), _scratch(spark, "parquet")
    sinks.write_result(rows.repartition(4), source)
    for _ in range(2):  # the second run finds nothing new
        csv_folder_to_parquet(spark, source, target, target + "-log", rows.schema, files_per_chunk=2)
    return spark.read.parquet(target)


@query("write_result", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def write_result(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    path = _scratch(spark, "result")
    sinks.write_result(rows, path, "parquet")
    return spark.read.parquet(path)


_TEXTS = "SELECT doc_id, text, ' ' || lang || ' ' AS padded FROM documents"


def _texts(spark, d) -> DataFrame:
    """Texts with commas, quotes and line breaks, and a field whose outer blanks count."""
    padded = F.concat(F.lit(" "), "lang", F.lit(" ")).alias("padded")
    return table(spark, d, "documents").select("doc_id", "text", padded)


@query("read_csv_texts", _TEXTS)
def read_csv_texts(spark, d):
    path = _scratch(spark, "csv")
    sinks.write_result(_texts(spark, d), path)
    return read_table(spark, path, "csv", _texts(spark, d).schema, exactly=True)


@query("csv_to_parquet_texts", _TEXTS)
def csv_to_parquet_texts(spark, d):
    source, target = _scratch(spark, "csv"), _scratch(spark, "parquet")
    sinks.write_result(_texts(spark, d), source)
    sinks.csv_to_parquet(spark, source, target, _texts(spark, d).schema)
    return spark.read.parquet(target)


@query(
    "html_lines",
    r"""
WITH b AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'),
    '(?i)<br\s*/?>|</(p|div|h[1-6]|li|tr|title)>', chr(10), 'g'),
    '<[^>]*>', '', 'g') AS body FROM pages),
l AS (SELECT page_id, list_filter(list_transform(string_split(body, chr(10)), lambda s: trim(s, ' ')), lambda s: s <> '')[1:250] AS lines FROM b)
SELECT page_id, CAST(unnest(generate_series(0, len(lines) - 1)) AS INTEGER) AS line_no, unnest(lines) AS line FROM l
""",
)
def html_lines(spark, d):
    return text.html_lines(table(spark, d, "pages").select("page_id", "html"), "html", 250)


# ---- projection and filters ---------------------------------------------------------------------


@query("select_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def select_columns(spark, d):
    return projection.select_columns(table(spark, d, "orders"), ["o_orderkey", "o_totalprice"])


@query("rename_columns", "SELECT c_custkey AS rec_id, c_name AS given_name, c_nationkey FROM customer")
def rename_columns(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    return projection.rename_columns(rows, {"c_custkey": "rec_id", "c_name": "given_name"})


@query("lowercase_headers", "SELECT s_suppkey AS suppkey, s_name AS supplier_name FROM supplier")
def lowercase_headers(spark, d):
    rows = table(spark, d, "supplier").selectExpr("s_suppkey as SuppKey", "s_name as Supplier_NAME")
    return projection.lowercase_headers(rows)


@query("standardise_headers", "SELECT c_name AS given_name, c_mktsegment AS state FROM customer")
def standardise_headers(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("state"))
    return projection.standardise_headers(rows, {"c_name": "given_name", "c_city": "city"}, ["given_name", "city", "state"])


@query("drop_columns", "SELECT p_partkey, p_name, p_brand FROM part")
def drop_columns(spark, d):
    return projection.drop_columns(table(spark, d, "part"), ["p_type", "p_size", "p_retailprice", "index"])


@query(
    "add_row_id",
    "SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS unique_id FROM orders",
)
def add_row_id(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return ordering.add_row_id(rows, ["o_orderdate", "o_orderkey"])


@query("head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 250")
def head(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return ordering.head(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], 250)


@query(
    "row_slices",
    "SELECT c_custkey, CAST(floor((row_number() OVER (ORDER BY c_name) - 1) / 50) AS BIGINT) AS slice_no FROM customer",
)
def row_slices(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    return ordering.row_slices(rows, ["c_name"], 50).drop("c_name")


@query("where_equals", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def where_equals(spark, d):
    rows = projection.where_equals(table(spark, d, "lineitem"), "l_returnflag", "R")
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


@query("in_set", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def in_set(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    return projection.in_set(rows, table(spark, d, "orders"), ["c_custkey"], ["o_custkey"])


@query(
    "not_in_set",
    "SELECT doc_id, lang FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)",
)
def not_in_set(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang")
    return projection.not_in_set(rows, table(spark, d, "labels"), ["doc_id"], ["doc_id"])


@query("flag_where", "SELECT event_id, CAST(CASE WHEN value > 5 AND event_type = 'purchase' THEN 1 ELSE 0 END AS INTEGER) AS big FROM events")
def flag_where(spark, d):
    rows = table(spark, d, "events")
    return projection.flag_where(
        rows, (F.col("value") > 5) & (F.col("event_type") == "purchase"), "big"
    ).select("event_id", "big")


@query("flagged_only", "SELECT doc_id, toxic FROM labels WHERE quality = 1")
def flagged_only(spark, d):
    return projection.flagged_only(table(spark, d, "labels"), "quality").select("doc_id", "toxic")


@query("cast_string", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def cast_string(spark, d):
    return projection.cast_string(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])


# ---- standardisation and privacy ----------------------------------------------------------------


def clean_sql(col: str) -> str:
    """The cleaning steps as SQL."""
    brackets = r"\[[^\n]*?\]|\([^\n]*?\)|\{[^\n]*?\}"
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({col}), '{brackets}', '', 'g'), "
        f"'[^ \\-_A-Za-z0-9]+', '', 'g'), '[\\-_]', ' ', 'g'), '\\s\\s+', ' ', 'g'))"
    )


@query("clean", f"SELECT doc_id, {clean_sql('text')} AS cleaned FROM documents")
def clean(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query(
    "clean_strings",
    f"SELECT conv_id, turn, {clean_sql('role')} AS role, {clean_sql('text')} AS text FROM conversations",
)
def clean_strings(spark, d):
    return text.clean_strings(table(spark, d, "conversations"))


@query(
    "mask_tail",
    "SELECT replace(CAST(c_custkey AS VARCHAR), right(CAST(c_custkey AS VARCHAR), 3), 'XXX') AS c_custkey, "
    "replace(c_name, right(c_name, 3), 'XXX') AS c_name, replace(c_mktsegment, right(c_mktsegment, 3), 'XXX') AS c_mktsegment, "
    "c_nationkey AS cluster_id FROM customer",
)
def mask_tail(spark, d):
    rows = table(spark, d, "customer").select(
        "c_custkey", "c_name", "c_mktsegment", F.col("c_nationkey").alias("cluster_id")
    )
    return text.mask_tail(rows)


_KEY = b"0123456789abcdef0123456789abcdef"  # a test key: jobs take theirs as an argument


@query("encrypt_columns", "SELECT c_custkey, CAST(1 AS INTEGER) AS name_hidden, CAST(1 AS INTEGER) AS segment_hidden FROM customer")
def encrypt_columns(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    hidden = privacy.encrypt_columns(rows, ["c_name", "c_mktsegment", "absent"], _KEY)
    both = hidden.withColumnsRenamed({"c_name": "hidden_name", "c_mktsegment": "hidden_segment"}).join(rows, "c_custkey")
    return both.select(
        "c_custkey",
        (~F.contains("hidden_name", "c_name")).cast("int").alias("name_hidden"),
        (~F.contains("hidden_segment", "c_mktsegment")).cast("int").alias("segment_hidden"),
    )


@query("decrypt_columns", "SELECT doc_id, text, lang FROM documents")
def decrypt_columns(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text", "lang")
    hidden = privacy.encrypt_columns(rows, ["text", "lang"], _KEY)
    return privacy.decrypt_columns(hidden, ["text", "lang"], _KEY)


# ---- profiles -----------------------------------------------------------------------------------

# events with gaps, so that null shares are not all zero
_GAPS = "SELECT event_id, CASE WHEN value > 1 THEN user_id END AS user_id, CASE WHEN value > 3 THEN event_type END AS event_type, value FROM events"


def _gaps(spark, d) -> DataFrame:
    rows = table(spark, d, "events")
    return rows.select(
        "event_id",
        F.when(F.col("value") > 1, F.col("user_id")).alias("user_id"),
        F.when(F.col("value") > 3, F.col("event_type")).alias("event_type"),
        "value",
    )


def _each(columns: list[str], stat: str, out: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {stat.format(c)} AS {out} FROM g" for c in columns)


_COLUMNS = ["event_id", "user_id", "event_type", "value"]


@query("missingness", f"WITH g AS ({_GAPS}) " + _each(_COLUMNS, "round(avg(CASE WHEN {0} IS NULL THEN 1.0 ELSE 0.0 END), 6)", "null_share"))
def missingness(spark, d):
    return profiling.missingness(_gaps(spark, d)).withColumn("null_share", F.round("null_share", 6))


@query("null_counts", f"WITH g AS ({_GAPS}) " + _each(_COLUMNS, "count(*) - count({0})", "null_count"))
def null_counts(spark, d):
    return profiling.null_counts(_gaps(spark, d))


_PROFILED = ["p_name", "p_brand", "p_type", "p_size"]
_VALUES = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS value_count FROM part WHERE {c} IS NOT NULL GROUP BY ALL"
    for c in _PROFILED
)


@query(
    "profile_columns",
    f"""
WITH v AS ({_VALUES}),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY value_count DESC, value) AS a,
             row_number() OVER (PARTITION BY column_name ORDER BY value_count, value) AS b FROM v)
SELECT column_name, 'top' AS part, CAST(a AS INTEGER) AS place, value, value_count FROM r WHERE a <= 10
UNION ALL SELECT column_name, 'bottom', CAST(b AS INTEGER), value, value_count FROM r WHERE b <= 5
""",
)
def profile_columns(spark, d):
    return profiling.profile_columns(table(spark, d, "part"), _PROFILED)


@query(
    "frequency_percentiles",
    f"""
WITH v AS ({_VALUES}),
f AS (SELECT column_name, value_count, CAST(sum(value_count) AS BIGINT) AS rows_held FROM v GROUP BY ALL)
SELECT column_name, value_count, rows_held, round(sum(rows_held) OVER (PARTITION BY column_name ORDER BY value_count DESC)
  / sum(rows_held) OVER (PARTITION BY column_name), 6) AS row_share FROM f
""",
)
def frequency_percentiles(spark, d):
    found = profiling.frequency_percentiles(table(spark, d, "part"), _PROFILED)
    return found.withColumn("row_share", F.round("row_share", 6))


@query(
    "value_occurrence",
    "WITH c AS (SELECT l_partkey, count(*) AS occurrences FROM lineitem GROUP BY 1) "
    "SELECT occurrences, count(*) AS \"values\" FROM c GROUP BY 1",
)
def value_occurrence(spark, d):
    return profiling.value_occurrence(table(spark, d, "lineitem"), "l_partkey")


@query("distinct_count", f"WITH g AS ({_GAPS}) " + _each(["user_id", "event_type"], "count(DISTINCT {0})", "distinct_values"))
def distinct_count(spark, d):
    return profiling.distinct_count(_gaps(spark, d), ["user_id", "event_type"])


@query("distinct_values", "SELECT DISTINCT p_name FROM part")
def distinct_values(spark, d):
    return profiling.distinct_values(table(spark, d, "part"), "p_name")


@query("row_count", "SELECT count(*) AS rows FROM lineitem")
def row_count(spark, d):
    return profiling.row_count(table(spark, d, "lineitem"))
