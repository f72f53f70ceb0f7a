"""Equal records as bundles: the pairs, scores, labels and links of their records are those of the records one by one."""

import hashlib

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinweave.operators import candidates, compare, correct, evaluate
from kinweave.operators import model as m
from kinweave.operators.cluster import connected_components
from kinweave.plans import pair_queries
from kinweave.plans.pair_queries import MODEL

RULES = [("name", "brand"), ("kind", "size", "brand")]
COLS = ["name", "brand", "kind", "size"]


def records(spark, repeated=False):
    names = ["anna bolt", "anne bolt", "red ring", None]
    rows = [(i, names[i % 4], f"B{i % 3 % 2}", ["LARGE", "LARGER"][i % 5 % 2], str(i % 2)) for i in range(60)]
    rows += [(None, "anna bolt", "B0", "LARGE", "0")]
    if repeated:
        rows += rows[:7] + [(3, "anna bolt", "B0", "LARGE", "0"), (3, "red ring", "B1", "LARGE", "1")]
    return spark.createDataFrame(rows, "id long, name string, brand string, kind string, size string")


def plain_pairs(df, other=None):
    """Pairs of the rules by a join of all rows."""
    l, r = (t.withColumnsRenamed({c: f"{c}_{s}" for c in t.columns}) for t, s in ((df, "l"), (other or df, "r")))
    first, second = (candidates.same_on(x) for x in RULES)
    key = F.when(first, 0).when(second, 1)
    pairs = l.join(r, first | second).withColumn("match_key", key)
    return pairs if other is not None else pairs.where("id_l < id_r")


def sorted_rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("repeated, tile", [(False, 3), (True, 10_000)])
def test_block_rules_keeps_pairs_and_sides(spark, repeated, tile, monkeypatch):
    monkeypatch.setattr(candidates, "BUNDLE_IDS", 4)
    df = records(spark, repeated)
    out = ["id_l", "id_r", "match_key", "name_l", "name_r", "size_l", "size_r"]
    found = candidates.block_rules(df, RULES, "id", keep=COLS, tile_rows=tile)
    assert sorted_rows(found, *out) == sorted_rows(plain_pairs(df), *out)
    linked = candidates.block_rules(df, RULES, "id", df.where("id < 20 or id is null"), keep=COLS, tile_rows=tile)
    assert sorted_rows(linked, *out) == sorted_rows(plain_pairs(df, df.where("id < 20 or id is null")), *out)


@pytest.mark.parametrize("threshold", [None, 0.7])
def test_predict_equals_scores_of_single_records(spark, threshold, monkeypatch, repeated=True):
    monkeypatch.setattr(candidates, "BUNDLE_IDS", 4)
    df = records(spark, repeated)
    got = m.predict(df, MODEL, "id", threshold=threshold)
    want = m.add_scores(plain_pairs(m.with_model_frequencies(MODEL, df, None)[0]), MODEL)
    want = want if threshold is None else want.where(F.col("match_probability") >= threshold)
    rounded = [F.round("match_weight", 9).alias("w")]
    assert sorted_rows(got, "id_l", "id_r", "match_key", *rounded) == sorted_rows(want, "id_l", "id_r", "match_key", *rounded)


def test_similarity_is_measured_on_few_rows_and_tasks_share_the_pairs(spark):
    """Copies are not compared one by one: 900 equal records in each of two groups are a few pairs of bundles."""
    df = spark.range(1800).selectExpr("id", "if(id % 2 = 0, 'anna bolt', 'anne bolt') as name", "'x' as size")
    rows = candidates.bundles(df, ["name", "size"], "id")
    pairs = candidates.block_rules(rows, [("size",)], candidates.BUNDLE, keep=["name"])
    assert pairs.count() < 100
    found = compare.add_gammas(pairs, [compare.name_comparison("name")])
    found = candidates.unfold(found.select(*candidates.BUNDLED, "gamma_name"), "id")
    assert found.count() == 1800 * 1799 // 2
    assert "BroadcastHashJoin" not in candidates.block(df, ["size"], "id")._jdf.queryExecution().toString()


def test_counts_and_labels_of_bundles(spark):
    df = records(spark).where("id is not null")
    rows = candidates.bundles(df, COLS, "id")
    pairs = candidates.block_rules(rows, RULES, candidates.BUNDLE)
    true = candidates.block(rows, ["name", "brand", "kind"], candidates.BUNDLE)
    labelled = evaluate.label_pairs(pairs, true, "_bundle_l", "_bundle_r", alike=True)
    labelled = labelled.select("label", F.lit(1).alias("predict"), candidates.pair_count().alias("pairs"))
    each = plain_pairs(df).withColumn("label", F.coalesce(candidates.same_on(("name", "brand", "kind")), F.lit(False)).cast("int"))
    each = each.withColumn("predict", F.lit(1))
    assert sorted_rows(evaluate.label_counts(labelled, pairs="pairs"), "label", "pairs") == sorted_rows(evaluate.label_counts(each), "label", "pairs")
    for measure in (evaluate.accuracy, evaluate.confusion_matrix, evaluate.classification_report):
        want = measure(each)
        assert sorted_rows(measure(labelled, pairs="pairs"), *want.columns) == sorted_rows(want, *want.columns)


@pytest.mark.parametrize("repeated", [False, True])
def test_spanning_links_join_the_same_records(spark, repeated):
    df = records(spark, repeated)
    rows = candidates.bundles(df, COLS, "id")
    pairs = candidates.block_rules(rows, RULES, candidates.BUNDLE)
    links = candidates.spanning_links(pairs.select(*candidates.BUNDLED), "id")
    assert links.count() < plain_pairs(df).count() / 2
    got = connected_components(links, "id_l", "id_r")
    want = connected_components(plain_pairs(df), "id_l", "id_r")
    assert sorted_rows(got, "node", "component") == sorted_rows(want, "node", "component")


def test_a_row_is_copied_to_a_bounded_number_of_tiles(spark):
    df = spark.range(2000).selectExpr("id", "0 as k")
    l, r, on = candidates.split_cells(df, df, ["k"], "id", True, 2)
    assert l.count() + r.count() <= 2000 * (candidates.MOST_PIECES + 1)
    pairs = candidates.join_block(df, df, ["k"], "id", True, 2)
    assert pairs.count() == 2000 * 1999 // 2


def split_by_hand(rows, share):
    """Marks of (key, label) rows from a sort by digest: how many of each label are marked, and which keys that are there once."""
    marks = {}
    for label in {l for _, l in rows if l is not None}:
        keys = sorted((hashlib.md5(f"{k}|10".encode()).hexdigest(), k) for k, l in rows if l == label)
        marks[label] = [k for _, k in keys[: int(len(keys) * share + 0.5)]]
    return marks


@pytest.mark.parametrize("share", [0.0, 0.1, 1.0])
def test_split_orders_few_rows(spark, share, monkeypatch):
    """Only rows near the cut of a label are sorted; the marks are those of a sort of all rows."""
    monkeypatch.setattr(evaluate, "LEAD", 2)
    sorted_sizes, whole = [], evaluate.add_row_id
    monkeypatch.setattr(evaluate, "add_row_id", lambda df, *a: (sorted_sizes.append(df.count()), whole(df, *a))[1])
    rows = [(k, [None, 0, 1, 1][k % 4]) for k in range(4000)]
    df = spark.createDataFrame(rows, "key long, label int")
    got = evaluate.stratified_split(df, "label", ["key"], share).collect()
    assert len(got) == len(rows) and all(r["is_test"] is None for r in got if r["label"] is None)
    want = split_by_hand(rows, share)
    assert {l: sorted(r["key"] for r in got if r["label"] == l and r["is_test"] == 1) for l in want} == {l: sorted(k) for l, k in want.items()}
    assert sum(sorted_sizes) < 100


def test_split_of_repeated_keys_and_of_whole_numbers(spark):
    """Rows of one key are told apart at the cut; a digest of 64 bits marks as many rows."""
    df = spark.range(1000).select((F.col("id") % 3).alias("key"), F.lit(1).alias("label"))
    for digest in (None, F.xxhash64("key")):
        got = evaluate.stratified_split(df, "label", ["key"], digest=digest)
        assert got.groupBy("is_test").count().orderBy("is_test").collect() == [(0, 900), (1, 100)]
    many = spark.range(5000).withColumn("label", F.col("id") % 2)
    marked = evaluate.stratified_split(many, "label", ["id"], digest=F.xxhash64("id"))
    assert sorted(marked.groupBy("label", "is_test").count().collect()) == [(0, 0, 2250), (0, 1, 250), (1, 0, 2250), (1, 1, 250)]


@pytest.mark.parametrize("odd", [False, True])
def test_neighbours_of_equal_names_are_bundles(spark, odd, monkeypatch):
    """Equal names are scored once; ids that are missing or repeated are paired row by row, as they may pair with themselves."""
    monkeypatch.setattr(candidates, "BUNDLE_IDS", 7)
    names = ["red ring", "red rings", "blue bolt", None, "red rung"]
    rows = [(i, names[i % 5]) for i in range(60)] + ([(None, "red ring"), (3, "red rung"), (0, "red rings")] if odd else [])
    df = spark.createDataFrame(rows, "id long, name string")
    place = {n: k for k, n in enumerate(sorted({n for n in names if n}))}
    known = [(i, n) for i, n in rows if n is not None]
    near = []
    for a, n in known:
        for b, o in known:
            if place[n] < place[o] <= place[n] + 1 or (n == o and None not in (a, b) and a < b):
                near.append((a, b, n, o) if None not in (a, b) and a < b else (b, a, o, n))
    got = candidates.sorted_neighbourhood(df, "name", "id", 3, keep=["name"])
    assert sorted_rows(got, "id_l", "id_r", "name_l", "name_r") == sorted(near, key=repr)
    alike = [p for p in near if p[2] == p[3] or {p[2], p[3]} == {"red ring", "red rings"}]
    assert sorted_rows(correct.provider_near_duplicates(df, "name", "id", 3), "id_l", "id_r", "name_l", "name_r") == sorted(alike, key=repr)
    if not odd:
        found = correct.provider_near_duplicates(candidates.bundles(df, ["name"], "id"), "name", candidates.BUNDLE, 3)
        assert found.count() < len(alike) / 4
        assert found.agg(F.sum(candidates.pair_count())).first()[0] == len(alike)


def part_table(folder, rows):
    """A table of parts from (key, name, brand, type, size)."""
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
    SparkSession.active().createDataFrame(rows, schema).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def some_parts():
    """Copies, a missing key, and three keys that are there several times."""
    names = ["hot bolt", "red ring", "hot belt"]
    rows = [(i, names[i % 3], f"B{i % 2}", ["SMALL", "LARGE"][i % 5 % 2], i % 4) for i in range(80)]
    return rows + rows[:1] + [(3, "hot bolt", "B1", "SMALL", 3), (3, "red ring", "B1", "LARGE", 1), (7, "hot bolt", "B1", "SMALL", 3), (None, "hot bolt", "B1", "SMALL", 3)]


def test_labels_and_unions_of_repeated_ids(spark, tmp_path):
    d = part_table(tmp_path / "t", some_parts())
    df = pair_queries._part(spark, d)
    each = plain_pairs(df).select("id_l", "id_r", "kind_l", "kind_r", "name_l", "name_r", "brand_l", "brand_r").collect()
    got = sorted_rows(pair_queries.union_candidates(spark, d), "id_l", "id_r")
    assert got == sorted({(r.id_l, r.id_r) for r in each}, key=repr)
    # two ids are a true link if any two of their records are
    linked = {(r.id_l, r.id_r) for r in each if r.kind_l == r.kind_r and r.name_l == r.name_r and r.brand_l == r.brand_r}
    want = [(r.id_l, r.id_r, int((r.id_l, r.id_r) in linked)) for r in each]
    assert sorted_rows(pair_queries.label_pairs(spark, d), "id_l", "id_r", "label") == sorted(want, key=repr)
    counts = [(k, sum(1 for w in want if w[2] == k)) for k in (0, 1)]
    assert sorted_rows(pair_queries.label_counts(spark, d), "label", "pairs") == counts
    # a prediction meets all pairs of its two ids
    alike = [(r.id_l, r.id_r) for r in each if r.kind_l == r.kind_r]
    want = [(r.id_l, r.id_r, int(r.name_l == r.name_r), p) for r in each for p in [1] * alike.count((r.id_l, r.id_r)) or [None]]
    assert sorted_rows(pair_queries.attach_predictions(spark, d), "id_l", "id_r", "name", "predict") == sorted(want, key=repr)
    table = pair_queries.truth_table_labels_column(spark, d).orderBy("threshold").first()
    assert table.tp + table.fp == len(each)


def test_one_repeated_id_leaves_all_others_in_bundles(spark, tmp_path, monkeypatch):
    """900 equal parts, one id twice: before, each of the 400,000 pairs was joined with the labels and predictions."""
    d = part_table(tmp_path / "t", [(i, "hot bolt", "B", "SMALL", 1) for i in range(900)] + [(5, "hot bolt", "B", "SMALL", 1)])
    seen = []
    for module, name in ((evaluate, "label_pairs"), (candidates, "attach_predictions"), (candidates, "union_candidates")):
        work = getattr(module, name)
        monkeypatch.setattr(module, name, lambda a, *rest, work=work, **how: seen.append(a.count()) or work(a, *rest, **how))
    pairs = 899 * 898 // 2 + 2 * 899
    assert pair_queries.label_pairs(spark, d).count() == pairs
    # each of the two records of the repeated id has the predictions of both
    assert pair_queries.attach_predictions(spark, d).count() == pairs + 2 * 899
    assert pair_queries.union_candidates(spark, d).count() == 900 * 899 // 2
    assert sum(seen) < 5000
    assert [tuple(r) for r in pair_queries.label_counts(spark, d).collect()] == [(1, pairs)]


def test_pairs_of_bundles_are_unfolded_by_many_tasks(spark, tmp_path):
    """Few bytes unfold to many pairs, so tasks must not be put together by bytes."""
    d = part_table(tmp_path / "t", some_parts()[:80])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("union_candidates", "attach_predictions", "label_pairs"):
        found = getattr(pair_queries, name)(spark, d)
        assert found.rdd.getNumPartitions() == n, name


def test_rows_of_two_bundles_are_not_held_at_once(spark):
    """Both explodes in one compiled loop keep all rows of a pair of bundles before the first is handed on."""
    rows = candidates.bundles(spark.range(300).selectExpr("id", "'x' as size"), ["size"], "id")
    found = candidates.unfold(candidates.block(rows, ["size"], candidates.BUNDLE), "id")
    assert found.distinct().count() == 300 * 299 // 2
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = candidates.unfold(rows.selectExpr("_bundle _bundle_l", "_bundle _bundle_r", "_ids _ids_l", "_ids _ids_r"), "id")
        lines = [l for l in plan._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate explode" in l]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(lines) == 2 and sum("*(" in l for l in lines) == 1


def test_factors_are_rounded_before_they_are_unfolded(spark, tmp_path, monkeypatch):
    """200 equal parts are one pair of bundles: before, ten factors of each of the 19,900 pairs were rounded."""
    d = part_table(tmp_path / "t", [(i, "hot bolt", "B", "SMALL", 1) for i in range(200)] + some_parts()[80:81])
    seen, work = [], candidates.unfold
    monkeypatch.setattr(candidates, "unfold", lambda p, *a: seen.append((p.count(), p.columns)) or work(p, *a))
    found = pair_queries.predict_intermediate(spark, d)
    assert found.select("id_l", "id_r").distinct().count() == 200 * 199 // 2
    assert len(seen) == 1 and seen[0][0] < 100 and "bf_tf_size" in seen[0][1]
