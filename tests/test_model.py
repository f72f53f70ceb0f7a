import json
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kinweave.operators import cluster, compare, evaluate, model as m
from kinweave.plans import jobs, models
from kinweave.schema import LinkJob


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        name = rng.choice(["anna", "anne", "bert", "berta", "carl", None])
        rows.append((i, name, rng.choice(["1990", "1991", "2001", None]), rng.choice("xy")))
    # copies: a fifth of the table is one record
    rows += [(200 + i, "anna", "1990", "x") for i in range(30)]
    return rows, spark.createDataFrame(rows, "unique_id int, name string, born string, place string")


def small_model():
    return m.Model(
        (
            compare.jaro_winkler_at("name", [0.9, 0.7], tf=True),
            compare.levenshtein_at("born", [1, 2]),
            compare.exact_match("place"),
        ),
        (("place", "name"), ("born",)),
        prior=0.01,
    )


def test_levels_of_edge_values(spark):
    rows = [("martha", "marhta"), ("a", "a"), (None, "a"), ("abcd", "wxyz"), ("", "")]
    df = spark.createDataFrame(rows, "n_l string, n_r string")
    got = [r[2] for r in compare.add_gammas(df, [compare.name_comparison("n")]).collect()]
    assert got == [2, 3, -1, 0, 3]
    got = [r[2] for r in compare.add_gammas(df, [compare.levenshtein_at("n", [1, 2])]).collect()]
    assert got == [1, 3, -1, 0, 3]


def test_patterns_do_not_depend_on_collapsing_copies(people):
    _, df = people
    cs = list(small_model().comparisons)[:2]
    got = m.pattern_counts(df, ("place",), cs, "unique_id").collect()
    plain = m.block_rules(df, [("place",)], "unique_id", keep=["name", "born"])
    want = compare.add_gammas(plain, cs).groupBy("gamma_name", "gamma_born").count().collect()
    assert {tuple(r[:2]): r[2] for r in got} == {tuple(r[:2]): r[2] for r in want}


def test_em_never_loses_likelihood(people):
    _, df = people
    model = m.estimate_u(small_model(), df, "unique_id")
    session = m.estimate_m_em(model, df, ("place",), "unique_id", rounds=8, tolerance=0.0)
    steps = session.log_likelihood
    assert session.rounds == 8 and all(b >= a - 1e-6 for a, b in zip(steps, steps[1:]))
    assert set(session.m) == {"name", "born"}
    for by in session.m.values():
        assert sum(by.values()) == pytest.approx(1.0)


def test_u_comes_from_all_pairs_below_the_cap(people):
    rows, df = people
    found = m.estimate_u(small_model(), df, "unique_id").comparison("place")
    x = sum(r[3] == "x" for r in rows)
    n = len(rows)
    same = (x * (x - 1) + (n - x) * (n - x - 1)) / (n * (n - 1))
    assert found.scored[0].u == pytest.approx(same)


def test_combining_takes_the_median_and_keeps_defaults():
    model = small_model()
    sessions = [m.Session((), {"place": {1: v, 0: 1 - v}}, 0.1, 1, ()) for v in (0.5, 0.9, 0.6)]
    out = m.combine_sessions(model, sessions)
    assert out.comparison("place").scored[0].m == 0.6
    assert [l.m for l in out.comparison("born").scored] == m.default_m(4)


def test_prior_counts_each_pair_once(people):
    _, df = people
    rules = [("name", "place"), ("born",)]
    row = m.estimate_prior(df, rules, "unique_id", 0.8).first()
    pairs = m.block_rules(df, rules, "unique_id").count()
    assert row["rule_pairs"] == pairs and row["prior"] == pytest.approx(pairs / 0.8 / (150 * 149 / 2))


def test_scores_are_the_sum_of_their_parts(people):
    _, df = people
    model = m.combine_sessions(m.estimate_u(small_model(), df, "unique_id"), [])
    for r in m.predict(df, model, "unique_id", retain_intermediate=True).limit(200).collect():
        odds = model.prior / (1 - model.prior) * r["bf_name"] * r["bf_born"] * r["bf_place"] * r["bf_tf_name"]
        assert r["match_weight"] == pytest.approx(math.log2(odds))
        assert r["match_probability"] == pytest.approx(odds / (1 + odds))


def test_stored_settings_round_trip(spark, people, tmp_path):
    _, df = people
    model = m.combine_sessions(m.estimate_u(small_model(), df, "unique_id"), [])
    m.save_model(model, spark, str(tmp_path / "model"))
    back = m.load_model(spark, str(tmp_path / "model"))
    key = ["unique_id_l", "unique_id_r", "match_weight"]
    assert sorted(m.predict(df, back, "unique_id").select(*key).collect()) == sorted(
        m.predict(df, model, "unique_id").select(*key).collect()
    )
    assert m.parameter_table(back, spark).count() == sum(len(c.levels) for c in model.comparisons)


def test_unknown_conditions_run_as_sql(spark):
    levels = [
        {"sql_condition": '"n_l" IS NULL OR "n_r" IS NULL', "is_null_level": True},
        {"sql_condition": 'substr("n_l", 1, 1) = substr("n_r", 1, 1)', "m_probability": 0.9, "u_probability": 0.1},
        {"sql_condition": "ELSE", "m_probability": 0.1, "u_probability": 0.9},
    ]
    settings = {
        "link_type": "dedupe_only",
        "blocking_rules_to_generate_predictions": ["l.k = r.k and l.n = r.n"],
        "comparisons": [{"output_column_name": "n", "comparison_levels": levels}],
    }
    model = m.from_settings(json.loads(json.dumps(settings)))
    assert model.rules == (("k", "n"),) and model.prior == m.DEFAULT_PRIOR
    df = spark.createDataFrame([("ab", "ac"), ("ab", "b"), (None, "b")], "n_l string, n_r string")
    assert [r[2] for r in compare.add_gammas(df, list(model.comparisons)).collect()] == [1, 0, -1]


def test_stored_probabilities_are_taken_as_they_are():
    def levels(name, *conditions):
        null = {"sql_condition": f'"{name}_l" IS NULL OR "{name}_r" IS NULL', "is_null_level": True}
        scored = [{"sql_condition": c, "m_probability": 0.6, "u_probability": 0.25} for c in conditions]
        return {"output_column_name": name, "comparison_levels": [null, *scored]}

    settings = {
        "link_type": "dedupe_only",
        "blocking_rules_to_generate_predictions": ["l.surname = r.surname", "l.postcode = r.postcode"],
        "comparisons": [
            levels("surname", '"surname_l" = "surname_r"', 'jaro_winkler_similarity("surname_l", "surname_r") >= 0.88', "ELSE"),
            levels("born", '"born_l" = "born_r"', 'levenshtein("born_l", "born_r") <= 2', "ELSE"),
        ],
        "probability_two_random_records_match": 0.0005,
    }
    model = m.from_settings(settings)
    assert model.rules == (("surname",), ("postcode",)) and model.prior == 0.0005
    assert [l.metric for l in model.comparison("surname").levels] == ["null", "exact", "jaro_winkler", "else"]
    assert [l.cut for l in model.comparison("born").levels] == [None, None, 2.0, None]
    # the m values sum to 1.8 and stay so
    assert [l.m for l in model.comparison("born").scored] == [0.6, 0.6, 0.6]
    assert m.from_settings(m.to_settings(model)).comparisons[1].levels[1:] == model.comparisons[1].levels[1:]


def union_find(n, edges):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("kind", ["random", "chain", "hub", "none"])
def test_components(spark, kind, monkeypatch):
    rng = random.Random(9)
    n = 200
    edges = {
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(120)],
        "chain": [(i, i + 1) for i in range(n - 1)],
        "hub": [(150, i) for i in range(n)],
        "none": [],
    }[kind]
    if kind == "hub":
        monkeypatch.setattr(cluster, "HUB_DEGREE", 20)
    pairs = spark.createDataFrame([(a, b, 0.9) for a, b in edges], "id_l int, id_r int, match_probability double")
    records = spark.range(n).withColumn("id", F.col("id").cast("int"))
    got = cluster.cluster_pairs(records, pairs, "id", 0.7).collect()
    assert {r["id"]: r["cluster_id"] for r in got} == dict(enumerate(union_find(n, edges)))


@pytest.mark.parametrize("threshold", [0.3, 0.9])
def test_collapsing_copies_keeps_the_clusters(people, threshold):
    rows, df = people
    model = m.combine_sessions(m.estimate_u(small_model(), df, "unique_id"), [])
    pairs = m.predict(df, model, "unique_id")
    want = cluster.cluster_pairs(df.select("unique_id"), pairs, "unique_id", threshold).collect()
    got = jobs.cluster_records(df, model, threshold).collect()
    assert len(got) == len(rows)
    assert {r["unique_id"]: r["cluster_id"] for r in got} == {r["unique_id"]: r["cluster_id"] for r in want}


def test_truth_against_a_label_column(people):
    _, df = people
    df = df.withColumn("cluster", F.concat_ws("/", "name", "born"))
    model = m.combine_sessions(m.estimate_u(small_model(), df, "unique_id"), [])
    scored = m.predict(df, model, "unique_id", carry=["cluster"]).select(
        F.round("match_weight", 3).alias("match_weight"), (F.col("cluster_l") == F.col("cluster_r")).cast("int").alias("label")
    )
    want = evaluate.truth_table(scored, missed=evaluate.true_pair_count(df, "cluster"))
    assert sorted(jobs.labelled_truth(df, model, digits=3).collect()) == sorted(want.collect())


def test_job_checks_its_input(spark, tmp_path):
    with pytest.raises(ValueError):
        LinkJob("febrl", "dedupe_only", "csv", ("a", "b"))
    with pytest.raises(ValueError):
        LinkJob("other", "dedupe_only", "csv", ("a",))
    spark.createDataFrame([("a",)], "given_name string").write.option("header", True).csv(str(tmp_path / "t.csv"))
    with pytest.raises(ValueError):
        jobs.run_job(spark, LinkJob("febrl", "dedupe_only", "csv", (str(tmp_path / "t.csv"),)))


def test_standard_models_are_complete():
    assert len(models.febrl_dedupe().model.comparisons) == 9
    assert len(models.febrl_link().model.comparisons) == 6
    assert models.febrl_link_detailed().threshold == 0.99 and len(models.SIX_RULES) == 6
    assert models.usa_dedupe_notebook().threshold == 0.75
    assert models.link_simple().model.tf_columns == ["given_name", "surname", "street_number"]


# ---- large blocks -------------------------------------------------------------------------------


def _errors(rng, word):
    at = rng.randrange(len(word))
    return word[:at] + rng.choice(["", "x", word[at] * 2]) + word[at + 1 :]


@pytest.fixture(scope="module")
def crowd(spark):
    """A third of the records share one surname, and half of those one town."""
    rng = random.Random(21)
    firsts = ["".join(rng.choices("abdeilnorst", k=rng.randint(3, 8))) for _ in range(25)]
    rows = []
    for i in range(330):
        name, town = rng.choice(firsts), rng.choice(["north", "south", "east"])
        surname = "smith" if i % 3 == 0 else rng.choice(["jones", "brown", "hill", None])
        born = f"19{rng.randint(10, 99)}"
        if rows and rng.random() < 0.3:
            _, name, surname, born, town = rng.choice(rows)
            name = _errors(rng, name) if name and rng.random() < 0.6 else name
            born = _errors(rng, born) if born and rng.random() < 0.3 else born
        if rng.random() < 0.05:
            born = None
        if rng.random() < 0.03:
            name = None
        rows.append((i, name, surname, born, town))
    return spark.createDataFrame(rows, "unique_id int, name string, surname string, born string, town string")


def crowd_model(tf):
    cs = (
        compare.name_comparison("name", tf=tf),
        compare.exact_match("surname"),
        compare.levenshtein_at("born", [1, 2]),
        compare.levenshtein_at("town", 2),
    )
    return m.Model(cs, (("surname",), ("town", "born")), prior=0.002)


@pytest.mark.parametrize(
    "tf, threshold, linked", [(False, 0.02, False), (True, 0.5, False), (True, 0.97, False), (False, 0.5, True)]
)
def test_large_blocks_lose_no_pair(crowd, tf, threshold, linked):
    model = m.combine_sessions(m.estimate_u(crowd_model(tf), crowd, "unique_id"), [])
    left, right = (crowd.where("unique_id % 2 = 0"), crowd.where("unique_id % 2 = 1")) if linked else (crowd, None)
    key = ["unique_id_l", "unique_id_r", "match_key"]
    every = m.predict(left, model, "unique_id", right).where(F.col("match_probability") >= threshold)
    want = {tuple(r) for r in every.select(*key).collect()}
    got = m.predict(left, model, "unique_id", right, threshold=threshold, tile_rows=20).select(*key).collect()
    assert want and len(got) == len(want) and {tuple(r) for r in got} == want


def test_large_blocks_form_few_pairs(crowd):
    from kinweave.operators import evidence

    model = m.combine_sessions(m.estimate_u(crowd_model(False), crowd, "unique_id"), [])
    cs = [m.filled(c) for c in model.comparisons]
    rows = crowd.where("surname = 'smith'")
    gain = m.log_odds(0.97) - m.log_odds(model.prior)
    cols = ["name", "surname", "born", "town"]
    pairs, _ = evidence.reaching_pairs(rows, rows, [("surname",)], cs, gain, "unique_id", True, cols, 20)
    n = rows.count()
    assert pairs.count() < n * (n - 1) / 2 / 2


def test_evidence_is_planned_from_the_weights():
    from kinweave.operators.evidence import plan_evidence

    def c(name, m_, u):
        return compare.exact_match(name).with_probabilities({1: m_, 0: 1 - m_}, {1: u, 0: 1 - u})

    cs = [c("a", 0.9, 0.01), c("b", 0.9, 0.001), c("d", 0.9, 0.45)]
    # a is the rule (6.5 bits); of the rest d alone gives 1 bit and can be left out
    kept = plan_evidence(cs, ("a",), 10.0, {})
    assert [e.comparison.name for e in kept] == ["b"]
    assert plan_evidence(cs, ("a",), 5.0, {}) is None
    assert plan_evidence(cs, ("a",), 40.0, {}) == []


@pytest.mark.parametrize("cut", [0.9, 0.88, 0.7, 0.5])
def test_close_values_are_sought_inside_a_block(spark, cut):
    """No pair is missed, and never more pairs are compared than the tiled block has."""
    from kinweave.operators.evidence import value_pairs
    from test_functions import plain_jaro_winkler

    rng = random.Random(6)
    words = [(k, w) for k in "xy" for w in {"".join(rng.choices("abcé", k=rng.randint(1, 9))) for _ in range(90)}]
    level = next(x for x in compare.jaro_winkler_at("v", [cut]).levels if x.metric == "jaro_winkler")
    pairs = value_pairs(spark.createDataFrame(words, "k string, v string"), ["k"], level, 20).collect()
    found = {(r["k_l"], r["v_l"], r["v_r"]) for r in pairs}
    sizes = [sum(k == x for k, _ in words) for x in "xy"]
    assert len(pairs) == len(found) <= sum(n * (n - 1) // 2 for n in sizes)
    assert all(
        (k, a, b) in found
        for k, a in words
        for q, b in words
        if k == q and a < b and plain_jaro_winkler(a, b) >= cut
    )


def tf_levels_model():
    """The term-frequency weight on similarity levels and on the last one, as stored models may have it."""

    def moved(c, at):
        tf = [replace(x, tf_column=c.column if k in at else None, tf_weight=1.0) for k, x in enumerate(c.levels)]
        return replace(c, levels=tuple(tf))

    name, born = compare.name_comparison("name"), compare.levenshtein_at("born", [1, 2])
    cs = (moved(name, {2}), compare.exact_match("surname"), moved(born, {2, 4}), compare.levenshtein_at("town", 2))
    return m.Model(cs, (("surname",), ("town", "born")), prior=0.002)


@pytest.mark.parametrize("tile_rows", [10_000, 16])
@pytest.mark.parametrize("threshold", [0.3, 0.7, 0.97])
def test_term_frequency_on_any_level_loses_no_pair(crowd, tile_rows, threshold):
    model = m.combine_sessions(m.estimate_u(tf_levels_model(), crowd, "unique_id"), [])
    key = ["unique_id_l", "unique_id_r", "match_key"]
    every = m.predict(crowd, model, "unique_id").where(F.col("match_probability") >= threshold)
    want = {tuple(r) for r in every.select(*key).collect()}
    got = m.predict(crowd, model, "unique_id", threshold=threshold, tile_rows=tile_rows).select(*key).collect()
    assert want and len(got) == len(want) and {tuple(r) for r in got} == want
