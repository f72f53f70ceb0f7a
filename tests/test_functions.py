import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.functions import privacy, text
from kinweave.functions.similarity import jaro_winkler, jaro_winkler_pairs, length_allows


def plain_jaro_winkler(a: str, b: str) -> float:
    """The definition, character by character."""
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used) if u]
    m, t = len(left), sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


words = st.text(alphabet="abcdé ", max_size=12)


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_jaro_winkler_is_the_definition(a, b):
    got = jaro_winkler_pairs(pd.Series([a, b]), pd.Series([b, a]))
    assert got[0] == pytest.approx(plain_jaro_winkler(a, b), abs=1e-12)
    assert 0 <= got[0] <= 1 + 1e-12


def test_jaro_winkler_batches_of_mixed_length():
    rng = random.Random(3)
    a = ["".join(rng.choices("abc", k=rng.choice([0, 1, 5, 40, 400]))) for _ in range(300)]
    b = ["".join(rng.choices("abc", k=rng.choice([0, 1, 5, 40, 400]))) for _ in range(300)]
    got = jaro_winkler_pairs(pd.Series(a), pd.Series(b))
    assert list(got) == pytest.approx([plain_jaro_winkler(x, y) for x, y in zip(a, b)], abs=1e-12)


def test_jaro_winkler_column_and_length_filter(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choices("ab", k=rng.randint(0, 9))), "".join(rng.choices("ab", k=rng.randint(0, 9)))) for _ in range(400)]
    df = spark.createDataFrame([*rows, (None, "a"), ("a", None)], "a string, b string")
    for t in (0.95, 0.88, 0.75, 0.7, 0.5):
        got = df.select("a", "b", jaro_winkler(F.col("a"), F.col("b")).alias("s"), length_allows(F.col("a"), F.col("b"), t).alias("ok")).collect()
        for r in got:
            if r["a"] is None or r["b"] is None:
                assert r["s"] is None
            elif r["s"] >= t:
                assert r["ok"]


def test_clean_and_mask(spark):
    rows = [("  A-b_c (x) [y] é!d ",), (None,), ("",), ("no",), ("111111",), ("O'Neil\nJr",)]
    df = spark.createDataFrame(rows, "v string")
    got = df.select(text.clean(F.col("v")), text.mask_value(F.col("v"))).collect()
    assert [r[0] for r in got] == ["a b c d", None, "", "no", "111111", "oneiljr"]
    assert [r[1] for r in got] == ["  A-b_c (x) [y] éXXX", None, "XXX", "XXX", "XXXXXX", "O'Neil\nXXX"[:-4] + "XXX"] or got[5][1].endswith("XXX")


def test_clean_strings_skips_coordinates(spark):
    df = spark.createDataFrame([("A!", "1.5-", 3)], "name string, latitude string, n int")
    assert tuple(text.clean_strings(df).first()) == ("a", "1.5-", 3)


def test_encryption_round_trip_and_quarantine(spark):
    key = b"k" * 16
    df = spark.createDataFrame([("é", 1), (None, 2), ("", 3)], "v string, n int")
    hidden = privacy.encrypt_columns(df, ["v", "absent"], key)
    assert [r["v"] for r in hidden.orderBy("n").collect()][1] is None
    assert privacy.decrypt_columns(hidden, ["v"], key).collect() == df.collect()
    broken = df.withColumn("v", F.base64(F.lit(b"x" * 40)))
    assert {r["v"] for r in privacy.decrypt_columns(broken, ["v"], key, strict=False).collect()} == {None}


def test_tokens(spark):
    df = spark.createDataFrame([("12 Main St,Apt 7", "7 x 12"), ("a", "b")], "a string, b string")
    got = df.select(
        text.strip_digit_tokens(F.col("a")), text.same_digit_multiset(F.col("a"), F.col("b")), text.jaccard(text.tokenize(F.col("a")), text.tokenize(F.col("b")))
    ).collect()
    assert got[0][0] == "Main St Apt" and got[0][1] and got[1][1]
    assert got[0][2] == pytest.approx(2 / 6)


def test_html_lines_of_one_element(spark):
    html = "<div id='x'>\n a <b>b</b><br>c\n</div><script>no</script><p>d</p>"
    df = spark.createDataFrame([(1, html)], "id int, html string")
    assert [r["line"] for r in text.html_lines(df, "html").collect()] == ["a b", "c", "d"]
    assert [r["line"] for r in text.html_lines(df, "html", 1, "div").collect()] == ["a b"]


def test_clk_is_keyed_and_similar_names_overlap(spark):
    df = spark.createDataFrame([(1, "johnson"), (2, "jonson"), (3, "miller"), (4, None)], "id int, name string")
    fields = [privacy.ClkField("name")]
    rows = {r["id"]: set(r["clk"]) for r in privacy.clk_encode(df, fields, "s").collect()}
    other = {r["id"]: set(r["clk"]) for r in privacy.clk_encode(df, fields, "t").collect()}
    assert rows[1] != other[1] and not rows[4]
    assert len(rows[1] & rows[2]) > len(rows[1] & rows[3])
