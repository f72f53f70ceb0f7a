"""CSV with line breaks in fields, read by ranges, against Spark's multi-line reader."""

import csv
import random

import pytest
from pyspark.sql import types as T

from kinweave.sources.splitcsv import ends_inside
from kinweave.sources.tables import CSV_OPTIONS, read_csv, read_table
from kinweave.streaming.convert import csv_folder_to_parquet

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def write(path, seed, n=700, breaks=True, end="\n"):
    rng = random.Random(seed)
    texts = ["plain", "", "comma, inside", 'a "quoted" word', " outer blanks ", '5" pipe', "ends with quote\"", "é日本"]
    if breaks:
        texts += ["two\nlines", 'odd " and\nbreak', '"\n"', "\n\n", "x," * 30 + "\n" + '"y"', "long\n" * 600, "carriage\r\nreturn"]
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(["id", "a", "b"])
        weights = [1 if len(t) > 1000 else 20 for t in texts]
        for i in range(n):
            out.writerow([i, *rng.choices(texts, weights, k=2)])


@pytest.mark.parametrize("breaks", [True, False])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_give_the_records_of_the_whole_file(spark, tmp_path, small_ranges, breaks, end):
    for k in range(2):
        write(tmp_path / f"part{k}.csv", k, breaks=breaks, end=end)
    got = read_table(spark, str(tmp_path), "csv")
    whole = read_table(spark, str(tmp_path), "csv", multiline=True)
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got.collect())) == sorted(map(key, whole.collect()))
    assert got.columns == whole.columns and got.count() == 1400
    assert got.rdd.getNumPartitions() > 2 == whole.rdd.getNumPartitions()
    typed = read_csv(spark, str(tmp_path), SCHEMA)
    assert sorted(r["id"] for r in typed.collect()) == sorted([*range(700)] * 2)
    with pytest.raises(ValueError, match="header"):
        read_csv(spark, str(tmp_path), T.StructType([SCHEMA["a"], SCHEMA["id"], SCHEMA["b"]]))


def test_lines_and_fields():
    cases = [('a,"b', True), ('a,"b""', True), ('a,"b"', False), ('a,b"c', False), ('"a"b,"c', True), ('""', False), ('"""', True), ("", False)]
    assert [ends_inside(line, False) for line, _ in cases] == [x for _, x in cases]
    assert [ends_inside(x, True) for x in ["abc", 'abc"', 'a"",b', 'a","', 'a","b"', '""']] == [True, False, True, True, False, True]


def test_an_empty_file_and_a_header_alone(spark, tmp_path):
    (tmp_path / "head.csv").write_text("id,a,b\n")
    assert read_csv(spark, str(tmp_path / "head.csv"), SCHEMA).collect() == []
    (tmp_path / "one.csv").write_text('id,a,b\n1,"x\ny",z')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "one.csv"), SCHEMA).collect()] == [(1, "x\ny", "z")]


def test_conversion_by_chunks_goes_on_where_it_stopped(spark, tmp_path, small_ranges):
    source = tmp_path / "in"
    source.mkdir()
    write(source / "a.csv", 1)
    for round_ in range(2):
        csv_folder_to_parquet(spark, str(source), str(tmp_path / "out"), str(tmp_path / "at"), SCHEMA, multiline=None)
        got = spark.read.parquet(str(tmp_path / "out"))
        want = spark.read.schema(SCHEMA).options(**CSV_OPTIONS, multiLine=True).csv(str(source))
        assert sorted(map(repr, got.select("id", "a", "b").collect())) == sorted(map(repr, want.collect()))
        write(source / "b.csv", 2, n=50)
