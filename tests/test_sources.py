import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave import session
from kinweave.operators import correct, geo, profiling, projection
from kinweave.schema import ADDRESS
from kinweave.sources import sinks
from kinweave.sources.tables import read_jdbc_tables, read_table


def test_address_tables_have_exactly_four_columns(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    spark.createDataFrame([("1 Main St", "Avon", "MA", "02322")], ADDRESS).write.option("header", True).csv(path)
    assert read_table(spark, path, schema=ADDRESS, exactly=True).first()["zip"] == "02322"
    wide = str(tmp_path / "b.csv")
    spark.createDataFrame([("a", "b", "c", "d", "e")], "address string, city string, state string, zip string, x string").write.option("header", True).csv(wide)
    with pytest.raises(ValueError):
        read_table(spark, wide, schema=ADDRESS, exactly=True)
    assert read_table(spark, wide, schema=ADDRESS).columns == ADDRESS.fieldNames()


@pytest.mark.parametrize("multiline", [False, True])
def test_column_oriented_json(spark, tmp_path, multiline):
    doc = {"address": {"0": "7 Long Ave", "1": "3 Short Dr"}, "city": {"0": "Leeds", "1": "Avon"}, "state": {"0": "MA", "1": None}, "zip": {"0": 2222, "1": 1111}}
    (tmp_path / "s.json").write_text(json.dumps(doc, indent=2 if multiline else None))
    df = read_table(spark, str(tmp_path / "s.json"), schema=ADDRESS, json_orient="columns", multiline=multiline)
    assert sorted(tuple(r)[::3] for r in df.collect()) == [("3 Short Dr", "1111"), ("7 Long Ave", "2222")]


def test_unknown_suffix_reads_as_csv(spark, tmp_path):
    (tmp_path / "t.dat").write_text("a,b\n1,x\n")
    assert read_table(spark, str(tmp_path / "t.dat")).first()["b"] == "x"


def test_jdbc_takes_one_or_two_tables(spark):
    with pytest.raises(ValueError):
        read_jdbc_tables(spark, "jdbc:none", "a,b,c")


def test_save_table_modes(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])
    one = spark.createDataFrame([(1, "a")], "id int, v string")
    sinks.save_table(one, "t_modes", schema, path=str(tmp_path / "t"))
    sinks.insert_into(one, "t_modes")
    assert spark.table("t_modes").count() == 2
    assert spark.table("t_modes").schema["id"].dataType == T.LongType()
    sinks.drop_table(spark, "t_modes")
    assert not spark.catalog.tableExists("t_modes")


def test_the_named_checkpoint_folder_wins(spark):
    class Named:
        class conf:
            get = staticmethod(lambda key, default=None: "/shared/folder/" if key == "spark.checkpoint.dir" else default)

    assert session.checkpoint_root(Named) == "/shared/folder"


def test_superseded_tables_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "checkpoint_root", lambda _: str(tmp_path))
    df = session.stage(spark.range(5).toDF("n"), "x")
    assert all(str(tmp_path) in f for f in df.inputFiles()) and df.count() == 5
    session.unstage(df)
    assert not list(tmp_path.rglob("*.parquet"))
    session.unstage(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))  # not ours: stays


def test_small_means_rows_and_bytes(spark):
    assert session.is_small(spark.range(10), rows=10)
    assert not session.is_small(spark.range(11), rows=10)
    assert not session.is_small(spark.range(4).select(F.repeat(F.lit("x"), 1000).alias("t")), size=3000)


def test_headers(spark):
    df = spark.createDataFrame([(1, 2, 3)], "First int, City int, zip int")
    assert projection.lowercase_headers(df).columns == ["first", "city", "zip"]
    got = projection.standardise_headers(df, {"First": "given_name", "City": "city"}, ["given_name", "city"])
    assert got.columns == ["given_name", "city"]
    with pytest.raises(ValueError):
        projection.with_positional_schema(df, ["a"])


def test_profiles_of_missing_values(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, None)], "x string, y string")
    assert {r[0]: r[1] for r in profiling.null_counts(df).collect()} == {"x": 1, "y": 3}
    assert {r[0]: r[1] for r in profiling.distinct_count(df, ["x", "y"]).collect()} == {"x": 1, "y": 0}


def test_places_near_the_date_line_and_the_pole(spark):
    places = spark.createDataFrame(
        [(1, 0.0, 179.9, "line"), (2, 89.9, 0.0, "pole"), (3, 10.0, 10.0, None)],
        "place_id long, latitude double, longitude double, display_name string",
    )
    df = spark.createDataFrame(
        [(1, 0.0, -179.9), (2, 89.9, 170.0), (3, 10.0, 10.1), (4, None, 1.0), (5, 50.0, 50.0)],
        "id int, latitude double, longitude double",
    )
    got = {r["id"]: r["display_name"] for r in geo.attach_place_name(df, places, 50.0).collect()}
    assert got == {1: "line", 2: "pole", 3: None, 4: None, 5: None}


def test_rejected_corrections_stay(spark):
    df = spark.createDataFrame([(1, "Watfor", "MA"), (2, "Newingon", "CT"), (3, None, "MA")], "id int, city string, state string")
    ref = spark.createDataFrame([("Watford", "MA", 1), ("Newington", "CT", 2)], "city string, state_id string, ref_order int")
    ref = ref.withColumn("city_state", F.concat_ws(",", "city", "state_id"))
    found = correct.suggest_corrections(correct.unknown_city_or_state(df, ref), ref)
    assert sorted((r[0], r[1]) for r in found.collect()) == [("Newingon,CT", "Newington,CT"), ("Watfor,MA", "Watford,MA")]
    fixed = correct.apply_corrections(df, found, found.where("original like 'Wat%'")).orderBy("id").collect()
    assert [r["city"] for r in fixed] == ["Watfor", "Newington", None]


@pytest.mark.parametrize("small", [True, False])
def test_replacing_tokens_with_small_and_large_mappings(spark, small, monkeypatch):
    monkeypatch.setattr(correct, "is_small", lambda _: small)
    df = spark.createDataFrame([(1, "12 Main St"), (2, "St  Ave"), (3, None)], "id int, t string")
    mapping = spark.createDataFrame([("St", "Street"), ("Ave", "Avenue")], "token string, replacement string")
    got = correct.replace_tokens(df, mapping, "t", "id").orderBy("id").collect()
    assert [r["t"] for r in got] == ["12 Main Street", "Street  Avenue", None]


def test_spelling_prefers_near_then_frequent(spark):
    words = spark.createDataFrame([("clinic", 5), ("clinics", 9), ("medical", 3)], "word string, frequency int")
    df = spark.createDataFrame([(1, "THE CLINIK MEDICL"), (2, "clinic xyzzy")], "id int, Provider_Name string")
    got = correct.spell_correct(df, words, "Provider_Name", "id").orderBy("id").collect()
    assert [r["Filtered_Name"] for r in got] == [" THE CLINIC MEDICAL", " CLINIC XYZZY"]


def test_column_documents_hold_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    from kinweave.plans import table_queries

    rows = spark.range(3000).selectExpr("id as s_suppkey", "concat('s', id) as s_name", "0 as s_nationkey", "1.5D as s_acctbal")
    rows.write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(table_queries, "_scratch", lambda *_: f"{tmp_path}/documents")
    got = table_queries.read_json_columns(spark, str(tmp_path))
    assert got.count() == 3000 and got.select("s_suppkey").distinct().count() == 3000
    assert spark.read.text(f"{tmp_path}/documents").count() == 3
