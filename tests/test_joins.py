"""Joins against brute force, with and without hot keys."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import candidates, fuzzyjoin, skew
from kinweave.operators.ordering import add_row_id, running_totals


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(11)
    # one value of a holds a third of all rows
    rows = [
        (i, "hot" if i % 3 == 0 else rng.choice(["x", "y", "z", None]), rng.choice(["p", "q", None]), rng.choice("mn"))
        for i in range(240)
    ]
    return rows, spark.createDataFrame(rows, "id int, a string, b string, c string")


RULES = [("a",), ("b", "c")]


def meets(x, y, rule) -> bool:
    at = {"a": 1, "b": 2, "c": 3}
    return all(x[at[k]] is not None and x[at[k]] == y[at[k]] for k in rule)


@pytest.mark.parametrize("tile_rows", [10_000, 7])
def test_block_rules_equal_the_or_join(people, tile_rows):
    rows, df = people
    want = {}
    for x, y in itertools.combinations(rows, 2):
        for k, rule in enumerate(RULES):
            if meets(x, y, rule):
                want[(x[0], y[0])] = k
                break
    got = candidates.block_rules(df, RULES, "id", keep=["c"], tile_rows=tile_rows).collect()
    assert len(got) == len(want)
    assert {(r["id_l"], r["id_r"]): r["match_key"] for r in got} == want
    by_id = {r[0]: r for r in rows}
    assert all(by_id[r["id_l"]][3] == r["c_l"] and by_id[r["id_r"]][3] == r["c_r"] for r in got)


@pytest.mark.parametrize("tile_rows", [10_000, 7])
def test_link_rules(people, tile_rows):
    rows, df = people
    left, right = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    want = {
        (x[0], y[0])
        for x in rows
        for y in rows
        if x[0] % 2 == 0 and y[0] % 2 == 1 and any(meets(x, y, r) for r in RULES)
    }
    got = candidates.block_rules(left, RULES, "id", right, tile_rows=tile_rows).collect()
    assert len(got) == len(want) and {(r["id_l"], r["id_r"]) for r in got} == want


@pytest.mark.parametrize("tile_rows", [10_000, 7])
@pytest.mark.parametrize("window", [1, 5])
def test_sorted_neighbourhood(people, tile_rows, window):
    rows, df = people
    pos = {v: i for i, v in enumerate(sorted({r[1] for r in rows if r[1]}))}
    want = {
        (x[0], y[0])
        for x, y in itertools.combinations(rows, 2)
        if x[1] and y[1] and abs(pos[x[1]] - pos[y[1]]) <= (window - 1) // 2
    }
    got = candidates.sorted_neighbourhood(df, "a", "id", window, tile_rows=tile_rows).collect()
    assert len(got) == len(want) and {(r["id_l"], r["id_r"]) for r in got} == want


@pytest.mark.parametrize("tile_rows", [10_000, 50])
def test_all_pairs(people, tile_rows):
    _, df = people
    pairs = candidates.all_pairs(df, "id", tile_rows=tile_rows)
    assert pairs.count() == pairs.distinct().count() == 240 * 239 // 2
    assert pairs.where("id_l >= id_r").count() == 0


def test_a_lopsided_link_sample_keeps_its_bound(spark, people):
    _, df = people
    many = spark.range(5000).select(F.col("id").cast("int").alias("id"))
    for other, bound in ((df.where("id = 3"), 100), (df.where("id < 7"), 100), (df, 1000)):
        for a, b in ((many, other), (other, many)):
            n = candidates.sample_pairs(a.select("id"), "id", bound, other=b.select("id")).count()
            assert bound / 2 < n <= bound


def test_sample_pairs(people):
    _, df = people
    pairs = candidates.sample_pairs(df, "id", 1000, keep=["a"])
    n = candidates.rows_for_pairs(1000)
    assert pairs.count() == n * (n - 1) // 2 <= 1000
    assert pairs.where("id_l >= id_r").count() == 0 and pairs.distinct().count() == pairs.count()
    linked = candidates.sample_pairs(df, "id", 500, other=df.where("id < 20"))
    assert 0 < linked.count() <= 500 and linked.distinct().count() == linked.count()


@pytest.mark.parametrize("small", [True, False])
def test_left_join_unique_keeps_every_row(spark, people, small, monkeypatch):
    rows, df = people
    monkeypatch.setattr(skew, "is_small", lambda _: small)
    monkeypatch.setattr(skew, "HOT_SHARE", 0.3)
    lookup = spark.createDataFrame([("hot", 1), ("x", 2), ("w", 3)], "a string, n int")
    got = {r["id"]: r["n"] for r in skew.left_join_unique(df, lookup, ["a"]).collect()}
    assert got == {r[0]: {"hot": 1, "x": 2}.get(r[1]) for r in rows}


@pytest.mark.parametrize("distance", [1, 2, 4])
@pytest.mark.parametrize("tile_rows", [10_000, 5])
def test_edit_join_finds_every_pair(spark, distance, tile_rows):
    rng = random.Random(distance)
    words = list({"".join(rng.choices("abé", k=rng.randint(0, 9))) for _ in range(150)})
    left, right = words[:60], words[40:]
    l = spark.createDataFrame(list(enumerate(left)), "id int, w string")
    r = spark.createDataFrame(list(enumerate(right)), "id int, w string")
    want = {(x, y, e) for x in left for y in right if (e := edit_distance(x, y)) <= distance}
    got = fuzzyjoin.edit_join(l, r, "w", "id", distance, tile_rows).collect()
    assert len(got) == len(want) and {(g["w_l"], g["w_r"], g["edits"]) for g in got} == want


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_cosine_join_finds_every_pair(spark, same, keys):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    points = [(i, i % 2, (centres[i % 6] + 0.4 * rng.normal(size=8)).tolist()) for i in range(120)]
    points.append((120, 0, [0.0] * 8))
    df = spark.createDataFrame(points, "id int, k int, v array<double>")
    left, right = (df, df) if same else (df.where("id < 70"), df.where("id >= 50"))

    def cos(a, b):
        return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))

    want = {
        (x[0], y[0])
        for x in points[:120]
        for y in points[:120]
        if (x[0] < y[0] if same else (x[0] < 70 and y[0] >= 50))
        and (not keys or x[1] == y[1])
        and cos(x[2], y[2]) >= 0.8
    }
    for tile_rows in (10_000, 4):
        got = fuzzyjoin.cosine_join(left, right, "v", "id", 0.8, keys, same, 8, tile_rows).collect()
        assert len(got) == len(want) and {(g["id_l"], g["id_r"]) for g in got} == want


def test_positions_and_running_totals(spark):
    df = spark.createDataFrame([(i % 50, i) for i in range(1000)], "a int, b int")
    ids = add_row_id(df, ["a", "b"], start=0)
    assert [r["unique_id"] for r in ids.orderBy("a", "b").collect()] == list(range(1000))
    sums = running_totals(df, "b", {"s": "a"}, descending=True).collect()
    total, want = 0, {}
    for i in reversed(range(1000)):
        total += i % 50
        want[i] = total
    assert {r["b"]: r["s"] for r in sums} == want


def test_attach_records_and_union(people):
    rows, df = people
    a = candidates.block(df, ["b"], "id")
    both = candidates.union_candidates(a, candidates.block(df, ["b", "c"], "id"))
    assert both.count() == a.count()
    got = candidates.attach_records(both, df.select("id", "a"), "id").where(F.col("id_l") == 0).collect()
    by_id = {r[0]: r[1] for r in rows}
    assert all(g["a_r"] == by_id[g["id_r"]] for g in got)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_vectors_without_structure_are_copied_to_few_cells(spark, keys, monkeypatch):
    """Each two tiles meet once. Before, all vectors went to most pivots, and from there to all tiles of their groups."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(400, 12))
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(vectors)], "id int, k int, v array<double>")
    copied, cells = [], fuzzyjoin.split_cells

    def counted(*how):
        l, r, on = cells(*how)
        copied.append(l.count() + r.count())
        return l, r, on

    monkeypatch.setattr(fuzzyjoin, "split_cells", counted)
    monkeypatch.setattr(fuzzyjoin, "MATRIX_ROWS", 20)
    got = fuzzyjoin.cosine_join(df, df, "v", "id", 0.5, keys, True, 8, 50).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    x, y = np.nonzero(np.triu(unit @ unit.T, 1) >= 0.5)
    assert sorted((r["id_l"], r["id_r"]) for r in got) == sorted(zip(x.tolist(), y.tolist(), strict=True))
    assert sum(copied) <= 400 * 9
