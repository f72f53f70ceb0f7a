"""Resampling, exact search and conversation repair against brute force and over awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from kinweave.llm import repair, resample, topk
from pyspark.sql import functions as F

# -- importance resampling -----------------------------------------------------------------------


def _plain_features(text):
    words = re.findall(resample.WORD, "".join(c.lower() if c.isascii() else c for c in text or ""))
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % resample.BUCKETS for r in runs]


def _plain_resample(rows, target):
    found = [(doc_id, *_plain_features(text)) for doc_id, text in rows]
    source, wanted = np.zeros((2, resample.BUCKETS), dtype=int)
    for _, _, runs in found:
        for b in runs:
            source[b] += 1
    for text in target:
        for b in _plain_features(text)[1]:
            wanted[b] += 1
    size_s, size_t = int(source.sum()), int(wanted.sum())
    out = []
    for doc_id, words, runs in found:
        weight = 0
        for b in runs:
            ratio = (int(wanted[b]) + 1) * (size_s + 10000) / ((int(source[b]) + 1) * (size_t + 10000))
            weight += math.floor(1000 * math.log(ratio))
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, words, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: 5 * len(able) // 100])}
    return [(*r, drawn.get(id(r))) for r in out]


def _texts(n, seed):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "ÉCLAT", "straße", "日本", "x1", "don't", "a-b", "ß", "TEST", "0", "\x00", "\x7f", "é́"]
    joints = [" ", "  ", "\n", ", ", "\t-\t", "\x00"]
    return ["".join(rng.choice(words) + rng.choice(joints) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_resample_equals_brute_force(spark):
    rows = list(enumerate(_texts(300, 1)))
    target = _texts(7, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=5).collect()
    assert sorted(map(tuple, got)) == sorted(_plain_resample(rows, target))
    assert sum(r["rank"] is not None for r in got) == 5 * sum(r["n_words"] >= 20 for r in got) // 100 > 5


def test_slices_of_a_text_give_its_features(monkeypatch):
    words = resample.Words()
    for text in [*_texts(50, 4), "x" * 500, " " * 300, "a " * 400, ""]:
        want = sorted(_plain_features(text)[1])
        for limit in (1, 2, 7, 64, 1 << 18):
            monkeypatch.setattr(resample.Words.slices, "__defaults__", (limit,))
            n, found = resample.features(text, words)
            assert sorted(found.tolist()) == want and n == _plain_features(text)[0]


def test_resample_over_awkward_rows(spark, documents):
    target = spark.createDataFrame([(None,), ("the quick brown fox",)], "text string")
    plain = resample.resample(documents(), target, percent=50).collect()
    clash = resample.resample(documents(extra=True), target, percent=50).collect()
    assert sorted(map(repr, plain)) == sorted(map(repr, clash)) and len(plain) == 10
    by_id = {r["doc_id"]: r for r in plain}
    assert by_id[3]["n_features"] == by_id[4]["weight"] == 0 and by_id[6]["n_features"] == 3 * 60_000 - 3
    drawn = sorted((r["rank"], r["doc_id"]) for r in plain if r["rank"] is not None)
    assert [r for r, _ in drawn] == [1, 2]  # of five rows with twenty words
    assert resample.resample(documents([]), target).collect() == []
    assert len(resample.resample(documents(), target.limit(0)).collect()) == 10
    kept = resample.draw(documents(), spark.createDataFrame([(1, 1), (None, 2)], "doc_id long, rank long"))
    assert sorted(map(repr, [r["doc_id"] for r in kept.collect()])) == ["1", "None"]


# -- exact search --------------------------------------------------------------------------------


def _plain_top(rows, k=5):
    """By loops over all pairs; each row is (id, vector)."""
    held = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, (i, v) in enumerate(held):
        if i is None or i % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j is None, j or 0, j) for b, (j, w) in enumerate(held) if a != b]
        out += [(i, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(map(repr, out))


def _run_top(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(topk.whole_numbers(df), F.col("vec_id") % 50 == 0, **more)
    return sorted(map(repr, map(tuple, found.collect())))


@pytest.mark.parametrize("block_values", [1 << 21, 64, 1])
def test_top_k_equals_brute_force(spark, block_values):
    rng = random.Random(7)
    some = [[rng.gauss(0, 1 / 4 ** (d // 4)) for d in range(20)] for _ in range(40)]
    rows = [(i, rng.choice(some) if i % 3 else [rng.gauss(0, 1) for _ in range(20)]) for i in range(400)]
    assert _run_top(spark, rows, block_values=block_values) == _plain_top(rows)


def test_top_k_over_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [1.0, 2.0]), (None, [1.0, 2.0]), (1, None), (100, [None, 1.0]), (2, [nan, 1.0]),
        (3, [inf, 0.0]), (4, []), (5, [3.0]), (150, [0.5, 0.5, 9.0]), (6, [-0.001, 0.0]), (200, []), (7, [1e6, -1e6]), (250, [2e6, 1.0]),
    ]
    assert _run_top(spark, rows) == _plain_top(rows)
    assert _run_top(spark, rows[:1]) == [] and _run_top(spark, []) == []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("row", "v", "score", "rank", "place"):
        df = df.withColumn(name, F.lit("clash"))
    got = topk.top_k(topk.whole_numbers(df), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(repr, map(tuple, got))) == _plain_top(rows)


def test_top_k_prunes():
    """With the mass in the first dimensions, most candidates leave before the last block of dimensions."""
    rng = np.random.default_rng(1)
    scale = np.repeat([400, 100, 10, 1], 16)
    values = (rng.normal(size=(6000, 64)) * scale).astype(np.int64)
    block = topk.QueryBlock(np.arange(100), np.arange(100), values[:100], 5)
    search = topk.Search(block)
    for low in range(0, 6000, 2000):
        search.offer(np.arange(low, low + 2000), np.arange(low, low + 2000), values[low : low + 2000])
    assert search.accumulated < 0.35 * search.compared * 64
    scores = values[:100] @ values.T
    scores[np.arange(100), np.arange(100)] = -(1 << 60)
    want = -np.sort(-scores, axis=1)[:, :5]
    assert np.array_equal(np.array(search.result()["score"]).reshape(100, 5), want)


def test_large_components_are_exact(spark):
    rows = [(0, [2.0**40, 3.0]), (1, [2.0**10, 1.0]), (2, [2.0**10, 2.0]), (3, [1e300, -1e300])]
    got = {r["vec_id"]: r["score"] for r in _top_rows(spark, rows)}
    # 2**48 times 2**18 leaves 64 bits; 3 * 256 times 256 more does not matter then
    assert got[1] == got[2] == got[3] == 2**63 - 1
    small = {r["vec_id"]: r["score"] for r in _top_rows(spark, [(0, [2.0**20, 3.0]), (1, [2.0**20, 1.0]), (2, [2.0**19, -1.0])])}
    assert small == {1: 2**56 + 768 * 256, 2: 2**55 - 768 * 256}


def _top_rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return topk.top_k(topk.whole_numbers(df), F.col("vec_id") == 0).collect()


# -- conversation repair -------------------------------------------------------------------------

FORM = re.compile(r"(s?(ua)+)?")


def _cheapest(rows):
    """Every list of edits with up to ``len(rows) + 2`` insertions, by enumeration; rows are (role, fault)."""
    best = None
    slots = len(rows) + 1

    def orders():
        for gaps in itertools.product(range(3), repeat=slots):
            for edits in itertools.product("DKR", repeat=len(rows)):
                yield gaps, edits

    for gaps, edits in orders():
        if sum(gaps) > 2:
            continue
        cost, audit, free = 0, "", []
        for at in range(slots):
            for _ in range(gaps[at]):
                cost, audit = cost + 5, audit + "I"
                free.append("ua")
            if at == len(rows):
                break
            role, fault = rows[at]
            audit += edits[at]
            if edits[at] == "D":
                cost += 2
                continue
            if fault in ("blank", "duplicate"):
                cost = None
                break
            cost += (edits[at] == "R") + (5 if fault == "truncated" else 0)
            free.append(role[:1] or "-" if edits[at] == "K" else "ua")
        if cost is None or best is not None and (cost, audit) >= best[:2]:
            continue
        for roles in itertools.product(*free):
            if FORM.fullmatch("".join(roles)):
                best = (cost, audit, "".join(roles))
                break
    return best


def test_lightest_derivations_equal_enumeration():
    rng = random.Random(11)
    roles = ["system", "user", "assistant", "tool", "user", "assistant", ""]
    faults = [None, None, None, "truncated", "blank", "duplicate"]
    for _ in range(150):
        rows = [(rng.choice(roles), rng.choice(faults)) for _ in range(rng.randrange(5))]
        light = [(r[:1], f) for r, f in rows]
        goal, choices = repair.lightest(light, dict(repair.AT_END), {repair.START})
        cost, audit, _ = _cheapest(rows)
        assert goal[repair.START][0] == cost
        state, got = repair.START, ""
        for (initial, _), choice in zip(light, choices):
            while choice[state] == "I":
                got += "I"
                state = repair.NEXT[state][repair.WANTED[state][0]]
            got += choice[state]
            if choice[state] != "D":
                state = repair.NEXT[state][initial if choice[state] == "K" else repair.WANTED[state][0]]
        while repair.AT_END[state][1]:
            got += "I"
            state = repair.NEXT[state][repair.WANTED[state][0]]
        assert got == audit


def _turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_blocks_give_the_same_repair(spark):
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "user", "assistant", "tool"]
    texts = ["Fine.", "Also fine!", "cut off", " ", "Why?", "one more thing."]
    rows = [(c, t, rng.choice(roles), rng.choice(texts) + str(rng.randrange(40)) * rng.randrange(2)) for c in range(3) for t in range(300)]
    want = repair.report(repair.repair(_turns(spark, rows))).collect()
    for size in (1, 7, 64):
        assert sorted(repair.report(repair.repair(_turns(spark, rows), block_rows=size)).collect()) == sorted(want)


def test_repair_of_known_faults(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Hello."),  # nothing to do
        (2, 3, "user", "Hi."), (2, 5, "user", "Are you there?"), (2, 9, "assistant", "Yes."),
        (3, None, "assistant", None), (3, 2, "system", "Be kind.\n"), (3, 2, "system", "Be kind.\n"), (3, 4, None, "Go on."),
        (None, 1, "user", "cut"),
    ]
    got = {r["conv_id"]: r for r in repair.report(repair.repair(_turns(spark, rows))).collect()}
    digest = lambda *lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert got[1][1:8] == (0, 0, 0, 0, 0, 0, "KK")
    assert got[1]["repaired_sha256"] == digest("user:Hi.", "assistant:Hello.")
    assert got[2][1:8] == (4, 0, 0, 0, 1, 2, "DKK")  # one of the two users goes, the first by its letter
    assert got[2]["repaired_sha256"] == digest("user:Are you there?", "assistant:Yes.")
    # a blank turn, a system turn twice, a row without a role: two rows change their role, two go
    assert got[3][1:8] == (1, 1, 1, 0, 3, 6, "DRDR")
    assert got[3]["repaired_sha256"] == digest("user:Be kind.\n", "assistant:Go on.")
    assert got[None][1:8] == (0, 0, 0, 1, 0, 2, "D") and got[None]["repaired_sha256"] == digest()


def test_repair_over_awkward_rows(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "word " * 30_000 + "." if c == 4 else f"Turn {t}.") for c in range(6) for t in range(4)]
    rows += [(7, 0, None, None), (7, 0, None, None), (None, None, "", ""), (8, 1, "ro\nle", "x.")]
    turns = _turns(spark, rows)
    clash = turns
    for name in ("nth", "fault", "choice", "step", "edit", "_copy", "was"):
        clash = clash.withColumn(name, F.lit("clash"))
    for frame in (turns, repair.damage(turns)):
        plain = repair.of_all(turns, repair.report(repair.repair(frame))).collect()
        assert len(plain) == 9
    other = repair.of_all(clash, repair.report(repair.repair(repair.damage(clash)))).collect()
    assert sorted(map(repr, plain)) == sorted(map(repr, other))
    empty = turns.limit(0)
    assert repair.of_all(empty, repair.report(repair.repair(repair.damage(empty)))).collect() == []


def test_conversations_without_rows_left(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    turns = _turns(spark, [(gone, 0, "user", "Hi.")])
    row = repair.of_all(turns, repair.report(repair.repair(repair.damage(turns)))).collect()[0]
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_damage(spark):
    rows = [(c, t, "assistant", "A. B! C?") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = {}
    for r in repair.damage(_turns(spark, rows)).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"]))
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = role or " ", text or " "
        kind = zlib.crc32(key.encode()) % 20
        want = {0: None, 1: [(role, "")], 2: [(role, re.sub("[.!?]", "", text))], 3: [(role, text)] * 2, 4: [("user", text)]}
        assert got.get((conv, turn)) == want.get(kind, [(role, text)])
