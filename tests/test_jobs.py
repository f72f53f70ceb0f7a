"""Whole jobs: what they read, keep, correct, profile and encrypt."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions.privacy import decrypt_columns
from kinweave.operators import correct, evaluate, geo
from kinweave.operators.compare import Feature
from kinweave.plans import jobs
from kinweave.schema import ENCRYPTED, LinkJob
from kinweave.session import checkpoint_root

FIELDS = "rec_id given_name surname street_number address_1 address_2 suburb postcode state date_of_birth soc_sec_id".split()


def persons(n, seed=5):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choices("abdeilnorst", k=k))
    rows = []
    for i in range(n):
        one = [word(6), word(7), str(rng.randint(1, 99)), word(9), word(5), word(6), str(rng.randint(1000, 1040)),
               rng.choice(["nsw", "vic"]), f"19{rng.randint(100000, 999999)}", str(rng.randint(10**6, 10**7))]
        for suffix in ("org", "dup"):
            row = list(one)
            if suffix == "dup":
                row[3] = row[3][:-1]
            rows.append([f"rec-{i}-{suffix}", *row])
    return rows


@pytest.fixture(scope="module")
def table_file(spark, tmp_path_factory):
    """A CSV with coordinates, a note with quotes, commas and line breaks, and the true cluster."""
    path = str(tmp_path_factory.mktemp("jobs") / "people.csv")
    rows = [(*r, 10.0, 20.0, 'a "note",\nover two lines ', r[0].rsplit("-", 1)[0]) for r in persons(60)]
    df = spark.createDataFrame(rows, [*FIELDS, "latitude", "longitude", "Remark", "cluster"])
    df.coalesce(1).write.options(header=True, quote='"', escape='"', ignoreTrailingWhiteSpace=False).csv(path)
    return path


def test_dedupe_job_keeps_columns_corrects_and_encrypts(spark, table_file):
    places = spark.createDataFrame(
        [(1, 11.0, 21.0, "WA", "4999", "perth"), (2, -60.0, 100.0, "TAS", "1", "hobart")],
        "place_id long, latitude double, longitude double, state string, postcode string, suburb string",
    )
    job = LinkJob("febrl", "dedupe_only", "csv", (table_file,), geocoding=True, profile=True)
    root = checkpoint_root(spark)
    key = b"0123456789abcdef"
    result = jobs.run_job(spark, job, places, key)
    got = result.clusters
    assert set(FIELDS) | {"latitude", "longitude", "Remark", "cluster", "cluster_id"} <= set(got.columns)
    rows = got.collect()
    assert len(rows) == 120 and all(r["Remark"] == 'a "note",\nover two lines ' for r in rows)
    plain = decrypt_columns(got, [c for c in ENCRYPTED["febrl"] if c in got.columns], key).collect()
    # the nearest place lies far outside any fixed radius, and every row takes it
    assert {(r["suburb"], r["postcode"]) for r in plain} == {("perth", "4999")}
    hidden = {r[c] for r in rows for c in ("date_of_birth", "soc_sec_id", "postcode") if r[c] is not None}
    assert not hidden & {r[c] for r in plain for c in ("date_of_birth", "soc_sec_id", "postcode")}
    assert result.missingness is not None and result.other_profile is None
    assert os.path.isdir(root.removeprefix("file://"))


def test_geocoding_without_its_inputs_raises(spark, table_file):
    job = LinkJob("febrl", "dedupe_only", "csv", (table_file,), geocoding=True)
    with pytest.raises(ValueError, match="gazetteer"):
        jobs.run_job(spark, job)


def test_link_job_reads_column_json_and_profiles_both_tables(spark, tmp_path):
    paths = []
    for k, suffix in enumerate(("org", "dup")):
        rows = [r for r in persons(60) if r[0].endswith(suffix)]
        whole = {c: {str(i): r[j] for i, r in enumerate(rows)} for j, c in enumerate(FIELDS)}
        path = tmp_path / f"side{k}.json"
        path.write_text(json.dumps(whole, indent=1))
        paths.append(str(path))
    job = LinkJob("febrl", "link_only", "json", tuple(paths), profile=True, json_orient="columns", multiline=True)
    result = jobs.run_job(spark, job)
    assert result.clusters.count() == 120 and result.truth is None
    assert result.profile.count() == result.other_profile.count() > 0
    assert result.other_missingness.count() > 0


def test_nearest_place_has_no_radius(spark):
    people = spark.createDataFrame([(i, -60.0 + 7 * i, 20.0 * i - 170) for i in range(18)] + [(99, None, 1.0)], "id int, latitude double, longitude double")
    places = spark.createDataFrame([(1, 5.0, 5.0, "a"), (2, -80.0, -100.0, "b")], "place_id int, latitude double, longitude double, display_name string")
    got = {r["id"]: r["display_name"] for r in geo.attach_place_name(people, places).collect()}
    both = people.dropna().crossJoin(places.selectExpr("latitude as la", "longitude as lo", "display_name as name"))
    km = geo.haversine_km(F.col("latitude"), F.col("longitude"), F.col("la"), F.col("lo"))
    want = {r["id"]: r["name"] for r in both.groupBy("id").agg(F.min_by("name", km).alias("name")).collect()}
    assert got == want | {99: None}
    near = {r["display_name"] for r in geo.attach_place_name(people, places, radius_km=10.0).collect()}
    assert near == {None}
    assert geo.attach_place_name(people, places.limit(0)).where("display_name is not null").count() == 0


def test_addresses_without_text_stay_alone_and_ids_may_be_text(spark):
    v = [1.0, 0.0]
    rows = [("x", "1 main st", v), ("y", "1 other st", v), ("z", "2 main st", v), ("n", None, v), ("m", None, v), ("a", "9 q", v), ("b", "9 r", v)]
    df = spark.createDataFrame(rows, "id string, text string, vector array<double>")
    got = {r["id"]: r["group_id"] for r in correct.cluster_addresses(df, "text", "vector", "id").collect()}
    assert got == {"a": 1, "b": 1, "x": 2, "y": 2, "z": 0, "n": 0, "m": 0}


def test_suggestions_by_embedding_with_text_ids(spark):
    ref = spark.createDataFrame([("p", [1.0, 0.0], "P"), ("q", [1.0, 0.0], "Q"), ("r", [0.0, 1.0], "R")], "id string, vector array<double>, name string")
    some = spark.createDataFrame([("k1", [1.0, 0.1]), ("k2", [-1.0, -1.0])], "id string, vector array<double>")
    got = {r["id"]: r["suggested"] for r in correct.suggest_by_embedding(some, ref).collect()}
    assert got == {"k1": "P", "k2": correct.NOTHING_FOUND}


def test_repeated_tokens_take_the_first_replacement(spark):
    df = spark.createDataFrame([(1, "a st b")], "id int, t string")
    mapping = spark.createDataFrame([("st", "street"), ("st", "saint")], "token string, replacement string")
    assert correct.replace_tokens(df, mapping, "t", "id").first()["t"] == "a saint b"


def test_split_and_matrix_keep_every_row(spark):
    df = spark.createDataFrame([(i, [0, 1, 2, None][i % 4], i % 3) for i in range(40)], "id int, label int, predict int")
    split = evaluate.stratified_split(df, "label", ["id"])
    assert split.count() == 40 and split.where("label is null and is_test is null").count() == 10
    matrix = {r["actual"]: r for r in evaluate.confusion_matrix(df).collect()}
    assert sum(r[f"predicted_{k}"] for r in matrix.values() for k in range(3)) == 40


@pytest.mark.parametrize("repeated", [False, True])
def test_classified_pairs_are_not_shuffled(spark, repeated, monkeypatch):
    """Records bring their fields and true links. Before, all pairs were shuffled to be told apart, filled and labelled."""
    rows = [(f"r{i:03}", ["ann", "anna", None][i % 3], str(i % 4) if i % 11 else None, f"s{i % 9}") for i in range(90)]
    rows += rows[:1] if repeated else []
    df = spark.createDataFrame(rows, "id string, name string, code string, surname string")
    truth = spark.createDataFrame([("r010", "r006"), ("r001", "r005"), ("r005", "r001"), ("r002", "r003"), ("r000", "r088"), ("r007", "none")], "id_l string, id_r string")
    staged, whole = {}, jobs.stage
    monkeypatch.setattr(jobs, "stage", lambda t, label: staged.setdefault(label, t) and whole(t, label))
    found, _ = jobs.classify_pairs(df, truth, [Feature("name", "exact")], ["code"], "surname", "id", trees=2)
    near = {f"s{k}": k for k in range(9)}
    true = {("r006", "r010"), ("r001", "r005"), ("r002", "r003"), ("r000", "r088")}
    want = set()
    for a, n, c, s in rows:
        for b, m, e, t in rows:
            if a < b and ((c is not None and c == e) or abs(near[s] - near[t]) <= 2):
                want.add((a, b, int(n is not None and n == m), int((a, b) in true)))
    got = [(r["id_l"], r["id_r"], r["name"], r["label"]) for r in found.collect()]
    assert set(got) == want and len(got) >= len(want) and (repeated or len(got) == len(want))
    plan = staged["labelled"]._jdf.queryExecution().optimizedPlan().toString()
    assert repeated or (plan.startswith("Union") and "Aggregate" not in plan)
    assert found.columns == ["id_l", "id_r", "name", "label", "is_test", "predict"]
