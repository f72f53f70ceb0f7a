"""Pairs measured as arrays: levels, counted scores and the pairs that reach a threshold are those of pair rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import candidates, compare, evidence, model as m, patterns

PEOPLE = "id long, copies long, given string, born string, town string, number string, cluster string"
COMPARED = (
    compare.name_comparison("given"),
    compare.levenshtein_at("born", [1, 2]),
    compare.jaro_winkler_at("town", [0.9, 0.7]),
    compare.exact_match("number", tf=True),
)


def _words(n: int, letters: str, longest: int) -> np.ndarray:
    draw = random.Random(n)
    found = ["".join(draw.choice(letters) for _ in range(draw.randint(0, longest))) for _ in range(n)]
    return np.array([*found, "", "aaaaaaaaaaaa", "aaaaaaaaaaab", "é" * 9, "𝒳éa", "martha", "marhta"], dtype=object)


@pytest.mark.parametrize(("letters", "longest"), [("ab", 12), ("abcdefgh", 20), ("aé𝒳0123456789", 64)])
def test_texts_are_measured_as_before(letters, longest):
    words = _words(120, letters, longest)
    texts = patterns.Texts.of(words)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    apart = words[i] != words[j]
    i, j = i[apart], j[apart]
    assert (np.minimum(texts.edits(i, j, 3), 4) == patterns.edit_distances(words[i], words[j], 3)).all()
    for cut in (0.5, 0.7, 0.88):
        got, wanted = texts.similarity(i, j, cut), patterns._similar(words[i], words[j], cut)
        assert (got[wanted >= cut] == wanted[wanted >= cut]).all()
        assert (got[wanted < cut] < cut).all()


def test_long_texts_are_measured_without_bits():
    words = np.array(["a" * 70 + "b", "a" * 70 + "c", "b"], dtype=object)
    assert patterns.Texts.of(words) is None
    field = patterns.Field(compare.levenshtein_at("x", [1, 2]), list(words))
    assert field.gammas(np.array([0, 0]), np.array([1, 2])).tolist() == [2, 0]


def _people(spark, n: int, seed: int):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        text = lambda some, size: None if draw.random() < 0.1 else "".join(draw.choice(some) for _ in range(size))
        rows.append((seed * 1000 + k, draw.randint(1, 3), draw.choice(["anna", "anne", "hanna", "otto", None]), text("012", 4), text("abc", 6), text("12", 1), draw.choice(["x", "y", "z", None])))
    return spark.createDataFrame(rows, PEOPLE)


def _model(rules):
    return m.Model(COMPARED, rules, prior=0.05)


RULES = (("given",), ("number", "cluster"))


@pytest.mark.parametrize("link", [False, True])
@pytest.mark.parametrize("tile_rows", [8, 10_000])
def test_scores_are_counted_without_rows_for_pairs(spark, link, tile_rows):
    model = _model(RULES)
    left, right = _people(spark, 60, 1), _people(spark, 40, 2) if link else None
    left, right = m.with_model_frequencies(model, left, right)
    got = m.score_counts(left, model, "id", "cluster", right, tile_rows)
    rows = m.predict(left, model, "id", right, carry=["cluster", "copies"], distinct=True)
    same = F.coalesce(F.col("cluster_l") == F.col("cluster_r"), F.lit(False)).cast("int").alias("label")
    rows = rows.select("match_weight", same, (F.col("copies_l") * F.col("copies_r")).alias("pairs"))

    def counted(df):
        return sorted(tuple(r) for r in df.groupBy("match_weight", "label").agg(F.sum("pairs")).collect())

    assert counted(got) == counted(rows)


@pytest.mark.parametrize("link", [False, True])
def test_only_pairs_that_reach_the_threshold_become_rows(spark, link):
    model = _model(RULES)
    left, right = _people(spark, 60, 1), _people(spark, 40, 2) if link else None
    left, right = m.with_model_frequencies(model, left, right)
    wanted = m.predict(left, model, "id", right, carry=["copies"], distinct=True).where("match_probability >= 0.6")
    for tile_rows in (8, 10_000):
        got = m.predict(left, model, "id", right, carry=["copies"], threshold=0.6, distinct=True, tile_rows=tile_rows)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    cs = [m.filled(c) for c in model.comparisons]
    keep = [*model.columns, "tf_number"]
    other = left if right is None else right
    made = [
        evidence.reaching_pairs(left, other, list(RULES), cs, m.log_odds(0.6) - m.log_odds(0.05), "id", not link, keep, 10_000, told)[0].count()
        for told in (False, True)
    ]
    assert made[1] == wanted.count() < made[0]
