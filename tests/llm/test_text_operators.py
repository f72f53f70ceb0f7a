"""Operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from compare import difference, duck
from kinweave.llm import bpe, catalog, fingerprint, packing, tokens
from kinweave.llm.checksums import crc32c, masked
from kinweave.llm.stages import byte_bpe_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return pd.read_parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(byte_bpe_path())
    found.no_truncation()
    found.no_padding()
    return found


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_sql(spark, name):
    if catalog.ORACLES[name] is not None:
        assert difference(catalog.QUERIES[name](spark, FOLDER), duck(FOLDER), catalog.ORACLES[name]) is None


def test_language_held_out(spark, rows):
    got = catalog.QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    held = got[got.held_out].merge(docs, on="doc_id")
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert ((got.score >= 0) & (got.score <= 1)).all()
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(got.doc_id, got.held_out, strict=True))


def test_quality_held_out(spark):
    got = catalog.QUERIES["op1_quality_classifier"](spark, "/root/testdata/sf0.01").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.93
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_fingerprints(spark, rows):
    got = catalog.QUERIES["op2_document_fingerprints"](spark, FOLDER).toPandas().set_index("doc_id")
    order = rows.sort_values("doc_id", ascending=False)
    texts = list(order.text)
    for doc_id, own, after in zip(order.doc_id, texts, texts[1:] + texts[:1], strict=True):
        changed = fingerprint.edited(own, after)
        row = got.loc[doc_id]
        assert row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and row.n_chars == len(own)
        a, b, c = (fingerprint.sketches([t]) for t in (own, changed, after))
        assert row.fingerprint == a[0].tobytes().hex() and row.edited_fingerprint == b[0].tobytes().hex()
        assert row.near_edited == fingerprint.likeness(a, b)[0] and row.near_next == fingerprint.likeness(a, c)[0]
    assert got.near_edited.mean() > 0.25 > 0.05 > got.near_next.mean()


def test_phrases_do_not_depend_on_the_offset(rows):
    text = max(rows.text, key=len)
    whole = fingerprint.sketches([text])
    for cut in (1, 5, 37, 200):
        assert fingerprint.likeness(whole, fingerprint.sketches([text[cut:]]))[0] > 0.8


def test_fingerprint_wraps_over_ranges(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * 9) for i in range(7)], "doc_id long, text string")
    assert len({r["doc_id"] for r in fingerprint.compare_with_next(docs).collect()}) == 7
    one = fingerprint.compare_with_next(docs.limit(1)).collect()
    assert one[0]["near_next"] == 1.0


HARD = ["", " ", "  ", "   a", "a  b   c ", "\n \n x", "a" * 40, "!!!!! ???", "<|endoftext|>x<|endoftext|><|endoftext|> y",
        "it's we'll I'D 'sword", "日本語 😀😀 a", "tab\t\tx \t y", "x ", " lead", "1,2.3 é.É, a.b", "é\r\n\r\n z", "a\0b"]


def test_both_encoders_equal_the_library(library, rows):
    own, other = bpe.Encoder(bpe.Vocabulary(byte_bpe_path())), tokens.LibraryEncoder(byte_bpe_path())
    rng = random.Random(5)
    odd = ["".join(rng.choice(" \n\t.,'ab1é!<|>") for _ in range(rng.randrange(30))) for _ in range(400)]
    texts = HARD + odd + list(rows.text)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in own.encode(texts)] == want
    assert [np.frombuffer(x, dtype=other.code).tolist() for x in other.encode(texts)] == want
    assert other.count(texts) == [len(x) for x in want]
    assert [bpe.decode(np.array(x), own.vocab) for x in want] == [
        library.decode(x, skip_special_tokens=False) for x in want
    ]


def test_pairs_merge_from_the_left():
    vocab = bpe.Vocabulary(byte_bpe_path())
    for n in range(1, 20):
        assert sum(len(vocab.bytes_of[i]) for i in np.frombuffer(bpe.merge_words([b"a" * n], vocab)[0], vocab.code)) == n


def test_round_trip_queries(spark, rows, library):
    files = catalog.QUERIES["op4_token_records"](spark, FOLDER).toPandas().set_index("doc_id")
    digests = catalog.QUERIES["op5_bpe_round_trip"](spark, FOLDER).toPandas().set_index("doc_id")
    start = 0
    for doc_id, text in sorted(zip(rows.doc_id, rows.text, strict=True)):
        ids = library.encode(text or "", add_special_tokens=False).ids
        row, other = files.loc[doc_id], digests.loc[doc_id]
        assert (row.start, row.n_tokens) == (start, len(ids) + 1)
        assert row.ids_crc32 == zlib.crc32(np.array([*ids, 2], dtype="<u4").tobytes())
        assert other.n_tokens == len(ids)
        assert other.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert other.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        start += len(ids) + 1


def test_checksums():
    assert crc32c([b"123456789"]).tolist() == [0xE3069283]

    def slow(data):
        c = 0xFFFFFFFF
        for x in data:
            c ^= x
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    rng = random.Random(2)
    texts = [rng.randbytes(n) for n in (0, 1, 4, 255, 256, 257, 1000)]
    assert crc32c(texts).tolist() == [slow(t) for t in texts]
    assert crc32c([]).tolist() == [] and masked(crc32c([b""])).tolist() == [0xA282EAD8]


def test_shuffled_reads_and_damage(spark, rows, library, tmp_path):
    docs = spark.createDataFrame(rows[["doc_id", "text"]].head(20))
    manifest = tokens.write_records(docs, byte_bpe_path(), f"file://{tmp_path}").collect()
    want = {int(i): library.encode(t, add_special_tokens=False).ids for i, t in zip(rows.doc_id, rows.text, strict=True)}
    for shard in manifest:
        places = list(range(shard["records"]))
        random.Random(1).shuffle(places)
        for doc_id, ids in tokens.read_at(f"file://{tmp_path}", shard.asDict(), places):
            assert ids.tolist() == [*want[doc_id], 2]
    path = tmp_path / manifest[0]["file"]
    data = bytearray(path.read_bytes())
    data[14] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="checksums"):
        tokens.read_records(spark.createDataFrame(manifest), f"file://{tmp_path}").collect()


def _best_fit(counts, capacity):
    """Piece by piece: the open bin with the least room that holds it, else a new bin."""
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            able = [r for r in rooms if r >= length]
            if able:
                rooms.remove(min(able))
                rooms.append(min(able) - length)
            else:
                rooms.append(capacity - length)
    return sorted(rooms)


def test_packing_is_best_fit():
    rng = random.Random(4)
    for _ in range(200):
        top = rng.choice([10, 60, 500])
        counts = {rng.randint(1, top): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
        plan = packing.plan_bins(counts, (top,))
        each = np.diff(plan.bin_first, append=plan.bins)
        assert sorted(np.repeat(top - plan.bin_used, each).tolist()) == _best_fit(counts, top)


def test_packing_with_several_lengths(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, rng.choice([0, 5, 100, 700, 2500, 9000])) for i in range(900)], "doc_id long, n_tokens long")
    for rows_of_shard in (50, 10_000):
        got = packing.pack(docs, shard_rows=rows_of_shard).toPandas()
        sizes = got.groupby("doc_id").length.sum()
        assert sizes.to_dict() == {r["doc_id"]: r["n_tokens"] for r in docs.collect()}
        full = got[got.length > 0].sort_values(["bin_id", "bin_offset"])
        assert got[got.length == 0].bin_id.isna().all()
        for _, b in full.groupby("bin_id"):
            assert b.bin_offset.tolist() == [0, *np.cumsum(b.length)[:-1]]
            used = b.length.sum()
            assert (b.bin_used == used).all() and b.bin_length.iloc[0] == min(c for c in packing.PERMITTED if c >= used)
