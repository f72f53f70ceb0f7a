"""Literal versions of four methods, written without the operators' code, and cases that once went wrong."""

import random

import numpy as np
import pytest
from kinweave.llm import archives, chat, fingerprint, language, packing, quality, stages

# -- neighbours vote -----------------------------------------------------------------------------


def _vote(query, vectors, labels, prior, k=15):
    near = [(max(round(float(sum(a * b for a, b in zip(query, v))), 6), 0.0), row) for row, v in enumerate(vectors)]
    near = sorted(near, key=lambda n: (-n[0], n[1]))[:k]
    total = sum(c**4 for c, _ in near)
    return sum(c**4 * labels[r] for c, r in near) / total if total else prior


def test_votes_by_plain_loops():
    rng = np.random.default_rng(5)
    x = rng.random((60, 30), dtype=np.float32)
    x[20:40] = x[20]  # equal rows, so that neighbours tie
    model = quality.NeighbourVote().fit(x, rng.integers(0, 2, 60), dimensions=6)
    texts = np.concatenate([x[15:45], rng.random((20, 30), dtype=np.float32)])
    want = [_vote(q, model.vectors, model.labels, model.prior) for q in model.project(texts)]
    assert np.allclose(model.score(texts), want, atol=1e-6)


@pytest.mark.parametrize("tries", range(5))
def test_ties_go_to_the_earlier_rows(tries):
    """300 equal neighbours, the earliest fifteen of them with label 1."""
    model = quality.NeighbourVote()
    model.vectors = np.tile(np.array([[0.6, 0.8]], dtype=np.float32), (300, 1))
    model.labels = (np.arange(300) < 15).astype(np.float32)
    model.idf, model.axes = np.ones(2, dtype=np.float32), np.eye(2, dtype=np.float32)
    assert model.score(np.random.default_rng(tries).random((4, 2), dtype=np.float32)).tolist() == [1.0] * 4


# -- locally consistent parsing -------------------------------------------------------------------

_MASK = (1 << 64) - 1


def _mix(x):
    """splitmix64's finaliser on one number."""
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def _toss(own, left):
    """The lowest bit in which two different numbers differ, and its value in the first."""
    bit = 0
    while (own >> bit) & 1 == (left >> bit) & 1:
        bit += 1
    return 2 * bit + ((own >> bit) & 1)


def _parse(symbols):
    """The names of one level's phrases, symbol by symbol."""
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    row = [s if n == 1 else _mix(s ^ _mix(n)) for s, n in runs]
    labels = row
    for k in range(4):
        first = (~labels[0] & _MASK) if k == 0 else labels[0] ^ 1
        labels = [_toss(x, labels[i - 1] if i else first) for i, x in enumerate(labels)]
    starts = [0] + [
        i for i in range(1, len(row) - 1) if labels[i] > labels[i - 1] and labels[i] >= labels[i + 1] and i + 1 < len(row)
    ]
    names = []
    for k, at in enumerate(starts):
        end = starts[k + 1] if k + 1 < len(starts) else len(row)
        names.append(_mix(sum(_mix((row[at + j] + j * 0xD1342543DE82EF95) & _MASK) for j in range(end - at)) & _MASK))
    return names


def _sketch(text):
    best = [None] * 128
    symbols = [ord(c) for c in text]
    for level in range(1, 5):
        symbols = _parse(symbols) if symbols else []
        if level >= 2 or len(symbols) == 1:
            for name in map(_mix, symbols):
                slot, value = name >> 57, name & ((1 << 57) - 1)
                best[slot] = value if best[slot] is None else min(best[slot], value)
    if not text:
        return bytes(128)
    out = []
    for slot in range(128):
        ahead = next(k for k in range(128) if best[(slot + k) % 128] is not None)
        out.append(_mix(best[(slot + ahead) % 128] + ahead) % 255 + 1)
    return bytes(out)


def test_parsing_symbol_by_symbol():
    rng = random.Random(3)
    texts = ["", "a", "ab", "aa", "aaaa", "abab", "日本語 é 😀", "x" * 300]
    texts += ["".join(rng.choices("ab c", k=rng.randrange(1, 400))) for _ in range(30)]
    texts += [" ".join("".join(rng.choices("etaoinshr", k=rng.randint(1, 8))) for _ in range(200)) for _ in range(6)]
    got = fingerprint.sketches(texts)
    assert [g.tobytes() for g in got] == [_sketch(t) for t in texts]
    for i in range(len(texts) - 1):
        same = sum(a == b for a, b in zip(_sketch(texts[i]), _sketch(texts[i + 1]))) / 128
        want = min(max((same - 1 / 255) / (1 - 1 / 255), 0.0), 1.0)
        assert fingerprint.likeness(got[i : i + 1], got[i + 1 : i + 2])[0] == pytest.approx(want)


# -- hierarchical discrimination --------------------------------------------------------------------


def _winner(names, margins):
    """Most pairs won, then the largest least margin, then the first name."""
    best = None
    for name in names:
        own = []
        for (a, b), m in margins.items():
            if a in names and b in names and name in (a, b):
                own.append(m if a == name else -m)
        key = (-sum(v > 0 for v in own), -min(own, default=10.0), name)
        best = min(best, (key, min(own, default=10.0))) if best else (key, min(own, default=10.0))
    return best[0][2], 1 / (1 + np.exp(-4 * min(max(best[1], -10), 10)))


def test_language_votes_by_plain_loops():
    rng = np.random.default_rng(8)
    words = {v: ["".join(rng.choice(list(a), 4)) for _ in range(30)] for v, a in
             {"en": "abcde", "de": "cdefg", "fr": "hijkl", "es": "jklmn", "pl": "opqrs", "it": "klmno"}.items()}
    texts = [(v, " ".join(rng.choice(w, 12))) for v, w in words.items() for _ in range(20)]
    x = np.stack([language.features(t) for _, t in texts])
    model = language.Discriminator(list(words)).fit(x, np.array([v for v, _ in texts]))
    mixed = np.stack([language.features(a + " " + b) for (_, a), (_, b) in zip(texts[::3], texts[5::3])])
    for row, (lang, score) in zip(mixed, model.predict(mixed), strict=True):
        margins = {p: float(w @ row + b) for p, w, b in zip(model.pairs, model.weights, model.bias, strict=True)}
        family, sure = _winner(model.families, margins)
        want, surer = _winner(model.members[family], margins)
        assert lang == want and score == pytest.approx(min(sure, surer), abs=1e-5)


def test_the_fit_is_bounded_and_the_stage_rejects_what_was_not_learnt(spark):
    rng = random.Random(2)
    vocabulary = {k: ["".join(rng.choices(a, k=rng.randint(2, 8))) for _ in range(60)] for k, a in (("en", "etaoinshrdlu"), ("fr", "eaéèsinrtuoçl"))}
    rows = [(i, " ".join(rng.choices(vocabulary[k], k=rng.randint(3, 200))), k) for i, k in enumerate(["en", "fr"] * 150)]
    foreign = [(1000 + i, " ".join("".join(rng.choices("абвгдежзиклмно", k=5)) for _ in range(rng.randint(20, 90))), None) for i in range(20)]
    foreign += [(2000 + i, "".join(rng.choices("日本語漢字仮名交文", k=120)), None) for i in range(20)]
    docs = spark.createDataFrame(rows + foreign, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "1L AS n_chars")
    kept = {r["doc_id"] for r in stages.known_language(spark, docs, "").select("doc_id").collect()}
    assert kept == {i for i, _, _ in rows}


def test_many_languages_share_the_rows_of_the_fit(spark, monkeypatch):
    monkeypatch.setattr(language, "TRAIN_ROWS", 120)
    rows = [(i, chr(0x4E00 + 30 * (i % 60)) * 3 + f" {i}", f"l{i % 60:02d}") for i in range(3000)]
    seen = []

    def counted(self, x, lang, chars=None):
        seen.append(len(x))
        return self

    monkeypatch.setattr(language.Discriminator, "fit", counted)
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 60 and 60 <= seen[0] <= 240


# -- best fit with several lengths -------------------------------------------------------------------


def _packed(counts, sizes, cost):
    """Piece by piece: the open bin with the least room that holds it, else a new bin of the least cost for what it can expect.

    None where bins of different lengths have the same least room, as either may take the piece.
    """
    bins = []  # [length of the bin, used]
    shorter = sum(n * k for n, k in counts.items())
    for length in sorted(counts, reverse=True):
        left = counts[length]
        shorter -= length * left
        capacity = None
        while left:
            able = [b for b in bins if b[0] - b[1] >= length]
            if not able:
                if capacity is None:
                    free = max(0, shorter - sum(b[0] - b[1] for b in bins))

                    def price(c, length=length, left=left, free=free):
                        own = min(left, c // length) * length
                        return cost(c) / (own + min(c - own, free))

                    capacity = min((c for c in sorted(sizes) if c >= length), key=lambda c: (price(c), -c))
                bins.append([capacity, 0])
                able = [bins[-1]]
            room = min(b[0] - b[1] for b in able)
            able = [b for b in able if b[0] - b[1] == room]
            if len({b[0] for b in able}) > 1:
                return None
            able[0][1] += length
            left -= 1
    return sorted((min(c for c in sizes if c >= used), used) for _, used in bins)


def test_packing_piece_by_piece_with_several_lengths():
    rng = random.Random(14)
    compared = 0
    for _ in range(600):
        sizes = tuple(sorted(rng.sample(range(5, 400), rng.randint(2, 4))))
        counts = {rng.randint(1, sizes[-1]): rng.randint(1, 25) for _ in range(rng.randint(1, 25))}
        want = _packed(counts, sizes, packing.training_cost)
        if want is None:
            continue
        compared += 1
        plan = packing.plan_bins(counts, sizes)
        each = np.diff(plan.bin_first, append=plan.bins)
        got = sorted(zip(np.repeat(plan.bin_length, each).tolist(), np.repeat(plan.bin_used, each).tolist()))
        assert got == want
    assert compared > 100


# -- chat and archives --------------------------------------------------------------------------------


def test_long_roles_and_clashing_columns(spark):
    roles = ["r" * 100_000, "\n" * 20_000, "\\" * 20_001 + "\n<", "assistant"]
    rows = [(1, t, r, f"text {t}") for t, r in enumerate(roles)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("position", "segment", "start", "_role", "context_end", "example"):
        turns = turns.selectExpr("*", f"'clash' AS {name}")
    import hashlib

    got = chat.read_back(*chat.write(turns)).collect()[0]
    want = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
    assert got["turns_sha256"] == want and got["n_examples"] == 1


def test_a_changed_context_is_noticed(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d")]
    stream, examples = chat.write(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    whole = {r["example"]: r["text"] for r in chat.example_texts(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), examples).collect()}
    assert whole[2].startswith(whole[1]) and whole[1].count("<|turn|>") == 2
    from pyspark.sql import functions as F

    broken = stream.withColumn("segment", F.replace("segment", F.lit("user\na"), F.lit("user\nx")))
    with pytest.raises(Exception, match="context"):
        chat.read_back(broken, examples).collect()


def test_operators_leave_what_their_result_reads(spark, documents):
    import corpus_pipeline
    from kinweave import session
    from kinweave.llm import lines, neardup

    def left(work):
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session._root(spark))
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = lambda: {f.getPath().getName() for f in fs.listStatus(root)} if fs.exists(root) else set()
        before = names()
        assert work().count() > 0
        return sorted(x.rsplit("-", 1)[0] for x in names() - before)

    assert left(lambda: neardup.classes(documents())) == ["classes", "sketches"]
    assert left(lambda: lines.judge(documents(), ["doc_id"])) == ["removed-words"]
    assert left(lambda: corpus_pipeline.run(spark, "/root/testdata/sf0.001")) == ["pipeline-packing"]


def test_conversion_runs_in_many_tasks(spark):
    pages = spark.range(400).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "repeat(cast(id AS string), 50) AS html", "'clash' AS file", "'clash' AS seq", "'clash' AS digest")
    folder, out = archives.new_folder(spark, "arc"), archives.new_folder(spark, "warc")
    manifest = archives.write_arc(pages.repartition(16), folder)
    assert manifest.count() >= 16
    written = archives.convert(manifest, folder, out)
    assert written.count() > 1  # each task writes files of its own
    assert len(archives.archive(pages).collect()) == 400
