"""Indexes and pre-aggregations against the plain way of doing the same."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave import session
from kinweave.operators import boost, candidates, classify, cluster, compare, fuzzyjoin, geo, model as m, ordering, patterns, valueindex
from kinweave.plans import jobs
from kinweave.schema import LinkJob
from test_joins import edit_distance


def level_of(c):
    return next(x for x in c.levels if x.metric in ("levenshtein", "jaro_winkler"))


def names(n, seed, letters="etaoinshrdlucmfwypvbgkjqxz"):
    rng = random.Random(seed)
    weights = [1 / (k + 1) ** 0.7 for k in range(len(letters))]
    out = set()
    while len(out) < n:
        w = "".join(rng.choices(letters, weights, k=rng.randint(3, 11)))
        out.add(w)
        if rng.random() < 0.3:
            at = rng.randrange(len(w))
            out.add(w[:at] + rng.choice(letters) + w[at + rng.randint(0, 1) :])
    return sorted(out)[:n]


@pytest.mark.parametrize("c", [compare.jaro_winkler_at("v", [0.9]), compare.jaro_winkler_at("v", [0.8]), compare.levenshtein_at("v", 2)])
def test_the_index_misses_no_close_value(spark, c):
    words = names(300, 3) + ["", "a", "ab", "smith", "smyth", "smithson", "日本語", "日本", "é" * 30, "e" * 30]
    df = spark.createDataFrame([(k, w) for k in ("x", "y") for w in words], "k string, v string")
    got = valueindex.candidate_pairs(df, ["k"], level_of(c), tile_rows=40).collect()
    found = {(r["k_l"], r["v_l"], r["v_r"]) for r in got}
    assert len(found) == len(got)
    pairs = [(a, b) for a in words for b in words if a < b]
    judged = patterns.levels_of(c, np.array([a for a, _ in pairs], dtype=object), np.array([b for _, b in pairs], dtype=object))
    close = [p for p, g in zip(pairs, judged) if g > 0]
    assert close and all((k, *p) in found for k in ("x", "y") for p in close)


@pytest.mark.parametrize("cut", [0.9, 0.88])
def test_the_index_compares_few_pairs(spark, cut):
    words = names(20_000, 8)
    df = spark.createDataFrame([("x", w) for w in words], "k string, v string")
    n = valueindex.count_candidates(df, ["k"], level_of(compare.jaro_winkler_at("v", [cut])))
    assert n < 0.05 * len(words) * (len(words) - 1) / 2


def test_edit_distances_of_many_pairs():
    rng = random.Random(1)
    words = ["".join(rng.choices("abc", k=rng.randrange(9))) for _ in range(60)] + ["日本語", "日本", "ab\0", "x" * 40]
    pairs = [(a, b) for a in words for b in words]
    for most in (1, 2, 3):
        got = patterns.edit_distances(*(np.array(x, dtype=object) for x in zip(*pairs)), most)
        assert got.tolist() == [min(edit_distance(a, b), most + 1) for a, b in pairs]


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(2)
    rows = [
        (i, rng.choice(["anna", "anne", "bert", "berta", "carl", "", None]), rng.choice(["1990", "1991", "2001", None]), rng.choice(["x", "y", None]), rng.randint(1, 3))
        for i in range(260)
    ]
    return spark.createDataFrame(rows, "id int, name string, born string, place string, copies long")


COMPARED = [compare.jaro_winkler_at("name", [0.9, 0.7]), compare.levenshtein_at("born", [1, 2]), compare.exact_match("place")]


@pytest.mark.parametrize("linked", [False, True])
@pytest.mark.parametrize("tile_rows", [10_000, 17])
@pytest.mark.parametrize("key", ["place", "name"])
def test_patterns_equal_those_of_pair_rows(people, linked, tile_rows, key, monkeypatch):
    left, right = (people.where("id % 3 > 0"), people.where("id % 3 = 0")) if linked else (people, people)
    cs = [c for c in COMPARED if c.column != key]
    pairs = candidates.join_block(left, right, [key], "id", not linked, tile_rows)
    named = [f"gamma_{c.name}" for c in cs]
    plain = compare.add_gammas(pairs, cs).withColumn("w", F.col("copies_l") * F.col("copies_r")).groupBy(*named).agg(F.sum("w"))
    assert patterns.can_tabulate(people, cs)
    got = patterns.block_patterns(left, right, [key], cs, "id", not linked, tile_rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_patterns_in_small_steps(people, monkeypatch):
    want = sorted(map(tuple, patterns.block_patterns(people, people, ["place"], COMPARED[:2], "id", True, 10_000).collect()))
    group = np.zeros(300, dtype=np.int64)
    rank, copies = np.arange(300), np.ones(300, dtype=np.int64)
    fields = lambda: [patterns.Field(COMPARED[0], [["anna", "anne", None][i % 3] for i in range(300)])]
    whole = patterns.count_patterns(group, np.full(300, patterns.ALONE), rank, copies, fields(), True)
    monkeypatch.setattr(patterns, "PAIRS_AT_ONCE", 100)
    assert patterns.count_patterns(group, np.full(300, patterns.ALONE), rank, copies, fields(), True) == whole
    assert sum(whole.values()) == 300 * 299 // 2 and want
    monkeypatch.setattr(patterns, "TABLE_CELLS", 1)
    assert patterns.count_patterns(group, np.full(300, patterns.ALONE), rank, copies, fields(), True) == whole


def test_em_on_the_driver_and_in_spark_agree(people):
    table = session.stage(m.pattern_counts(people.drop("copies"), ("place",), COMPARED[:2], "id"), "patterns")
    model = [m.filled(c) for c in COMPARED[:2]]
    local = m.run_em(table, model, 0.05, rounds=6, tolerance=0.0)
    spread = m.run_em(table, model, 0.05, rounds=6, tolerance=0.0, local_patterns=0)
    assert local.prior == pytest.approx(spread.prior)
    assert local.log_likelihood == pytest.approx(spread.log_likelihood)
    for c, by in spread.m.items():
        assert local.m[c] == pytest.approx(by)


# -- components ----------------------------------------------------------------------------------


def _components(found):
    return {r["node"]: r["component"] for r in found.collect()}


@pytest.mark.parametrize("kind", ["star", "chain"])
def test_large_stars_and_chains_need_few_rounds(spark, kind, monkeypatch):
    n, rounds = 100_000, []
    plain = cluster._large_star
    monkeypatch.setattr(cluster, "_large_star", lambda e: rounds.append(1) or plain(e))
    order = list(range(n))
    random.Random(4).shuffle(order)
    edges = [(order[0], x) for x in order[1:]] if kind == "star" else list(zip(order, order[1:]))
    pairs = spark.createDataFrame(spark.sparkContext.parallelize(edges, 8), "a long, b long").repartition(8)
    got = cluster.connected_components(pairs, "a", "b")
    assert got.count() == n and got.select("component").distinct().count() == 1
    assert len(rounds) <= 2


@pytest.mark.parametrize("node", ["int", "string", "binary"])
@pytest.mark.parametrize("local", [0, 1 << 18])
def test_components_with_and_without_the_last_task(spark, node, local):
    from test_model import union_find

    rng = random.Random(9)
    n = 150
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(110)] + [(5, 5), (7, 8), (7, 8)]
    pairs = spark.createDataFrame(edges, "a int, b int").repartition(5)
    shown = pairs.select(*[(F.lpad(F.col(c).cast("string"), 4, "0") if node != "int" else F.col(c)).cast(node).alias(c) for c in "ab"])
    got = {int(k): int(v) for k, v in _components(cluster.connected_components(shown, "a", "b", local_edges=local)).items()}
    want = union_find(n, edges)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}


def test_components_after_more_links(spark):
    from test_model import union_find

    rng = random.Random(3)
    n = 200
    first, more = ([(rng.randrange(n), rng.randrange(n)) for _ in range(k)] for k in (90, 40))
    known = session.stage(cluster.connected_components(spark.createDataFrame(first, "a int, b int"), "a", "b"), "known")
    got = _components(cluster.join_components(known, spark.createDataFrame(more, "a int, b int"), "a", "b"))
    want = union_find(n, first + more)
    assert got == {x: want[x] for a, b in first + more if a != b for x in (a, b)}


# -- counts of rule pairs -------------------------------------------------------------------------


def test_all_rules_are_counted_in_one_scan(people):
    rules = [("name",), ("born", "place"), ("name", "place"), ("born",)]
    found = candidates.new_pairs(people, rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") <= 2  # the records, and the signs
    pairs = candidates.block_rules(people, rules, "id").groupBy("match_key").count().collect()
    assert {r["match_key"]: r["new_pairs"] for r in found.collect()} == {r["match_key"]: r["count"] for r in pairs}
    a, b = people.where("id % 2 = 0"), people.where("id % 2 = 1")
    linked = candidates.block_rules(a, rules, "id", b).groupBy("match_key").count().collect()
    assert {r[0]: r[1] for r in candidates.new_pairs(a, rules, b).collect() if r[1]} == {r[0]: r[1] for r in linked}


# -- classifier ----------------------------------------------------------------------------------


def test_trees_on_counts_equal_trees_on_rows():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (400, 4)).astype(float)
    y = ((x[:, 0] == 1) & (x[:, 2] == 0) | (rng.random(400) < 0.05)).astype(float)
    rows, back = np.unique(x, axis=0, return_inverse=True)
    ones = np.bincount(back.reshape(-1), weights=y, minlength=len(rows))
    zeros = np.bincount(back.reshape(-1), weights=1 - y, minlength=len(rows))
    on_counts = boost.fit_trees(rows, ones, zeros, list("abcd"), 30, 4, 0.1)
    on_rows = boost.fit_trees(x, y, 1 - y, list("abcd"), 30, 4, 0.1)
    assert np.allclose(on_counts.margins(rows), on_rows.margins(rows))
    clear = (x[:, 0] == 1) & (x[:, 2] == 0)
    assert ((on_counts.margins(x) > 0) == clear).all()


def test_classifier_is_stored_and_falls_back(spark, tmp_path, monkeypatch):
    rows = [(i, i % 2, (i // 2) % 2, int(i % 2 == 1)) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, a int, b int, label int")
    fitted = classify.fit_pair_classifier(df, ["a", "b"])
    assert isinstance(fitted, boost.Trees) and len(fitted.trees) == classify.TREES
    classify.save_classifier(fitted, str(tmp_path / "own"))
    monkeypatch.setattr(classify, "LOCAL_PATTERNS", 2)
    spread = classify.fit_pair_classifier(df, ["a", "b"], trees=2, depth=2)
    assert not isinstance(spread, boost.Trees)
    classify.save_classifier(spread, str(tmp_path / "spark"))
    for name in ("own", "spark"):
        back = classify.load_classifier(str(tmp_path / name))
        assert all(r["predict"] == r["label"] for r in classify.predict_pairs(back, df).collect())


# -- stored rules --------------------------------------------------------------------------------


@pytest.mark.parametrize("rule", ["l.a = r.a OR l.b = r.b", "l.a = r.a AND substr(l.c,1,3) = substr(r.c,1,3)", "l.a = r.b", "", "l.a = r.a AND"])
def test_rules_of_another_form_are_refused(rule):
    settings = {"link_type": "dedupe_only", "blocking_rules_to_generate_predictions": [rule], "comparisons": []}
    with pytest.raises(ValueError, match="rule"):
        m.from_settings(json.loads(json.dumps(settings)))
    assert m.read_rule('l."a" = r."a" and l.b=r.b') == ("a", "b")


# -- row ids -------------------------------------------------------------------------------------


def test_equal_rows_are_spread(spark, monkeypatch):
    written = []
    plain = ordering.stage

    def seen(df, label):
        out = plain(df, label)
        sizes = out.groupBy(F.spark_partition_id()).count().collect()
        written.append(sorted(r[1] for r in out.groupBy(F.shiftright("_at", 33)).count().collect()))
        return out if sizes else out

    monkeypatch.setattr(ordering, "stage", seen)
    df = spark.range(90_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 5).alias("k"))
    got = ordering.add_row_id(df, ["k"], partitions=16)
    last = written[-1]
    assert len(written) == 2 and last[-1] <= 2 * last[len(last) // 2]
    rows = got.collect()
    assert sorted(r["unique_id"] for r in rows) == list(range(1, 90_001))
    by_id = [r["k"] for r in sorted(rows, key=lambda r: r["unique_id"])]
    assert by_id == sorted(by_id)


# -- places --------------------------------------------------------------------------------------


def test_points_far_from_all_places_meet_few(spark):
    rng = random.Random(1)
    places = [(i, rng.uniform(40, 45), rng.uniform(-80, -70), "p") for i in range(100_000)]
    points = [(rng.uniform(-60, -20), rng.uniform(60, 150)) for _ in range(10_000)]
    gazetteer = spark.createDataFrame(places, "place_id int, latitude double, longitude double, display_name string")
    kept = geo._places_in_leaves(gazetteer, ["display_name"], "latitude", "longitude", "place_id")
    visits = geo.leaves_to_visit(spark.createDataFrame(points, "_lat double, _lon double"), kept)
    size = len(places) / kept.select("leaf").distinct().count()
    assert visits.count() * size < 0.05 * len(places) * len(points)


def test_nearest_places_equal_brute_force(spark):
    rng = random.Random(2)
    places = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180), f"p{i}") for i in range(900)] + [(900 + i, 50.0, 8.0 + i / 1e4, "town") for i in range(700)]
    places += [(5000, None, 1.0, "x"), (5001, 89.99, 179.9, "pole"), (5002, 50.0, 8.0, "twin")]
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(200)] + [(500, 50.0, 8.00001), (501, -89.9, 10.0), (502, 0.0, 180.0), (503, None, 1.0)]
    gazetteer = spark.createDataFrame(places, "place_id int, latitude double, longitude double, display_name string")
    df = spark.createDataFrame(points, "id int, latitude double, longitude double")

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * geo.EARTH_KM * math.asin(min(1.0, math.sqrt(h)))

    for radius in (None, 700.0):
        got = {r["id"]: r["display_name"] for r in geo.attach_place_name(df, gazetteer, radius).collect()}
        for i, lat, lon in points:
            if lat is None:
                assert got[i] is None
                continue
            best = min((km(lat, lon, a, b), k, n) for k, a, b, n in places if a is not None)
            assert got[i] == (best[2] if radius is None or best[0] <= radius else None)
    assert geo.attach_place_name(df, gazetteer.limit(0)).where("display_name is not null").count() == 0


# -- cosine --------------------------------------------------------------------------------------


def test_only_the_best_partner_leaves_a_tile(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 8))
    vectors[200:] = vectors[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id int, vec array<double>")
    left, right = df.where("id < 90"), df.where("id >= 90")
    for tile_rows in (2000, 100, 40):
        every = fuzzyjoin.cosine_join(left, right, "vec", "id", 0.3, tile_rows=tile_rows).collect()
        best = fuzzyjoin.cosine_join(left, right, "vec", "id", 0.3, tile_rows=tile_rows, best=True)
        tops = {}
        for r in every:
            tops[r["id_l"]] = max(tops.get(r["id_l"], (-1.0, 0)), (round(r["cosine"], 9), -r["id_r"]))
        rows = best.collect()
        got = {}
        for r in rows:
            got[r["id_l"]] = max(got.get(r["id_l"], (-1.0, 0)), (round(r["cosine"], 9), -r["id_r"]))
        assert got == tops and len(rows) <= len(every)


def test_a_product_is_left_once_no_entry_can_reach_the_threshold():
    early, late = np.eye(8)[:2], np.eye(8)[4:6]
    assert fuzzyjoin.bounded_product(late, late.T, 0.9) is not None  # the rest could still reach it
    assert fuzzyjoin.bounded_product(early, late.T, 0.9) is None
    assert fuzzyjoin.bounded_product(early[:1], early[1:].T, 0.9) is None


# -- staged tables --------------------------------------------------------------------------------


def _files(spark):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session._root(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {f.getPath().getName() for f in fs.listStatus(root)} if fs.exists(root) else set()


def test_scratch_tables_go(spark):
    before = _files(spark)
    with session.scratch(spark) as made:
        kept = made.keep(session.stage(spark.range(3), "kept"))
        session.stage(spark.range(4), "gone")
        with session.scratch(spark) as inner:
            inner.keep(session.stage(spark.range(5), "handed-out"))
    assert kept.count() == 3
    assert len(_files(spark) - before) == 1
    session.unstage(kept)
    assert _files(spark) == before


def test_a_job_leaves_its_records_and_clusters_only(spark, tmp_path):
    from kinweave.plans.job_queries import people as persons

    persons(spark, "/root/testdata/sf0.001").write.option("header", True).csv(str(tmp_path / "people.csv"))
    before = _files(spark)
    result = jobs.run_job(spark, LinkJob("febrl", "dedupe_only", "csv", (str(tmp_path / "people.csv"),)))
    assert result.clusters.count() == 200
    left = sorted(f.rsplit("-", 1)[0] for f in _files(spark) - before)
    assert left == ["merged", "records"]
