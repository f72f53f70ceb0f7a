"""Near duplicates against brute force, archives and chats in detail, and the pipeline as a whole."""

import gzip
import io
from collections import Counter

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from kinweave.llm import archives, catalog, chat, lines, neardup

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    words = text.lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def similarity(a, b):
    keys = set(a) | set(b)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in keys) for i in a if i in b)


def brute_classes(rows):
    """Classes by comparing all pairs of texts."""
    rows = [(i, t or "") for i, t in rows]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = sum((sets[i] & sets[j]).values())
            near = rows[i][1] == rows[j][1] or (common and similarity(sets[i], sets[j]) >= 0.8)
            if near and find(i) != find(j):
                root[find(i)] = find(j)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return {frozenset(g) for g in groups.values()}


def test_exact_similarity():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = Counter(rng.integers(0, 12, rng.integers(1, 30)).tolist())
        b = Counter(rng.integers(0, 12, rng.integers(1, 30)).tolist())
        pack = [(np.array(sorted(c), dtype=np.uint64), np.array([c[k] for k in sorted(c)], dtype=float)) for c in (a, b)]
        assert neardup.probability_jaccard(*pack) == pytest.approx(similarity(a, b))


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.9):
        agreed = []
        for _ in range(40):
            common, own = rng.integers(1, 1 << 60, 60), rng.integers(1, 1 << 60, (2, 60))
            n = int(share * 60)
            a, b = (np.sort(np.concatenate([common[:n], o[n:]])).astype(np.uint64) for o in own)
            of = np.repeat([0, 1], 60)
            got = neardup.registers(of, np.concatenate([a, b]), np.ones(120), 2)
            agreed.append((got[0] == got[1]).mean())
        assert np.mean(agreed) == pytest.approx(n / (120 - n), abs=0.04)


def test_near_duplicates_by_brute_force(spark):
    rows = pd.read_parquet(f"{FOLDER}/documents.parquet")
    got = catalog.QUERIES["op3_minhash_near_duplicates"](spark, FOLDER).toPandas()
    found = {frozenset(g) for g in got.groupby("class_id").doc_id.agg(list)}
    assert found == brute_classes(list(zip(rows.doc_id, rows.text, strict=True)))
    assert (got.groupby("class_id").doc_id.min() == got.groupby("class_id").first().index).all()


def edited_copies(n, words=120):
    """Copies of a text with edits of growing number, chains of copies of copies, and other texts."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(words)]
    rows = []
    for i in range(n):
        text = list(base)
        for k in rng.choice(words, int(rng.integers(0, 9)), replace=False):
            text[k] = f"e{i}x{k}"
        rows.append((i, " ".join(text)))
    return rows


def test_a_group_of_edited_copies(spark, monkeypatch):
    """Links that only some pairs of a bucket have are found, in tiles of several blocks too."""
    rows = edited_copies(90)
    want = brute_classes(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (512, 16):
        monkeypatch.setattr(neardup, "BLOCK_TEXTS", block)
        got = neardup.classes(docs).toPandas()
        assert {frozenset(g) for g in got.groupby("class_id").doc_id.agg(list)} == want


def test_arc_versions_are_read(spark):
    body = archives.http_block(9, "pâge".encode())
    for version in ("1", "2"):
        data = archives.arc_version_record(version, "f") + archives.arc_record(version, "http://a b/", "text/html", body, 200, "f", 0)
        first, second = archives.read_arc(io.BytesIO(data), "f")
        assert archives.warc_type(first) == "warcinfo" and second["url"] == "http://a%20b/" and second["body"] == body
    dns = archives.arc_record("1", "dns:a", "text/dns", b"1.2.3.4", 200, "f", 0)
    assert archives.warc_type(list(archives.read_arc(io.BytesIO(archives.arc_version_record("1", "f") + dns)))[1]) == "resource"
    with pytest.raises(ValueError, match="not an ARC header"):
        list(archives.read_arc(io.BytesIO(b"some text\n")))
    with pytest.raises(ValueError, match="bytes of"):
        list(archives.read_arc(io.BytesIO(data[:-9])))
    assert archives.warc_date("20010203040506") == "2001-02-03T04:05:06Z" and archives.warc_date("1999") == "1999-01-01T00:00:00Z"


def test_archives_by_brute_force(spark):
    pages = pd.read_parquet(f"{FOLDER}/pages.parquet")
    pages.loc[pages.index[5:9], "html"] = pages.html.iloc[2]
    df = spark.createDataFrame(pages[["page_id", "url", "html"]])
    got = archives.archive(df).toPandas().set_index("page_id")
    first = pages.groupby("html").page_id.min()
    for page_id, html in zip(pages.page_id, pages.html, strict=True):
        row, payload = got.loc[page_id], html.encode()
        assert row.payload_bytes == len(payload) and row.payload_digest == archives.sha1_digest(payload)
        if first[html] == page_id:
            assert row.record_type == "response" and pd.isna(row.refers_to)
        else:
            assert row.record_type == "revisit" and row.refers_to == first[html]
    small = archives.archive(df, min_payload=10**9).toPandas()
    assert (small.record_type == "response").all()


def test_a_page_with_the_address_of_a_version_block(spark):
    rows = [(1, "filedesc://x.arc", "body"), (2, "http://a/", "body"), (3, "http://b/", "other")]
    got = archives.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got} == {
        (1, "response", None), (2, "revisit", 1), (3, "response", None)}


def test_files_roll_and_members_open_alone(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "text " * i) for i in range(50)], "page_id long, url string, html string")
    manifest = archives.write_arc(pages, f"file://{tmp_path}", file_records=7)
    rows = manifest.collect()
    assert sum(r["records"] for r in rows) == 50 and max(r["records"] for r in rows) <= 7
    for r in rows:
        with gzip.open(tmp_path / r["file"]) as f:
            assert len(list(archives.read_arc(f))) == r["records"] + 1


def test_examples_in_full(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "be <kind>"), (1, 1, "user", "hi"), (1, 2, "assistant", "a[1]"), (1, 3, "user", "more"), (1, 4, "assistant", "\\b")],
        "conv_id long, turn long, role string, text string",
    )
    formatted = chat.format_turns(turns)
    texts = {r["example"]: r for r in chat.example_texts(formatted, chat.expand(formatted)).collect()}
    assert len(texts) == 2 and texts[2]["text"].startswith(texts[1]["text"])
    assert [texts[k]["text"][texts[k]["loss_start"] : texts[k]["loss_end"]] for k in (1, 2)] == ["a\\[1]", "\\\\b"]


def test_lines_of_many_documents_are_removed(spark):
    letters = str.maketrans("0123456789", "abcdefghij")
    unique = lambda i: " ".join(f"u{i}n{k}".translate(letters) for k in range(40))
    shared = "Accept the terms and cookies of this site number 5 now please " * 3
    rows = [(i, f"{unique(i)}\n{shared}", "h") for i in range(30)]
    rows += [(100 + i, f"tiny{i} words\n{shared}\n{shared}", "h") for i in range(5)]
    rows += [(200 + i, unique(7) + " " + unique(8), "h") for i in range(200)]  # copies are one document
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = lines.judge(df, ["doc_id"]).toPandas().set_index("doc_id")
    assert (got.loc[range(30)].removed_words == 36).all() and got.loc[range(30)].kept.all()
    assert not got.loc[range(100, 105)].kept.any()
    assert got.loc[range(200, 400)].kept.all()


def test_near_copies_do_not_reject_themselves(spark):
    """Near copies hold a third of a host; a template of several lines on the other pages is still removed."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7))
    base = [[word() for _ in range(33)] for _ in range(12)]
    menu = "\n".join(" ".join(word() for _ in range(14)) for _ in range(5))
    rows = []
    for i in range(150):
        copy = [list(x) for x in base]
        copy[rng.integers(12)][rng.integers(33)] = word()
        rows.append((i, "\n".join(" ".join(x) for x in copy), "h"))
    for i in range(300):
        own = " ".join(word() for _ in range(25 if i % 4 == 0 else 120))
        rows.append((1000 + i, f"{menu}\n{own}" if i % 4 == 0 else own, "h"))
    got = lines.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id"])
    got = got.toPandas().set_index("doc_id")
    assert got.loc[range(150)].kept.all() and (got.loc[range(150)].removed_words == 0).all()
    menus = got.loc[range(1000, 1300, 4)]
    assert (menus.removed_words == 70).all() and not menus.kept.any()
    assert got.loc[[1000 + i for i in range(300) if i % 4]].kept.all()


def test_pipeline(spark):
    rows = pd.read_parquet(f"{FOLDER}/documents.parquet")
    got = corpus_pipeline.run(spark, FOLDER).toPandas()
    kept = set(got.doc_id)
    quality = catalog.QUERIES["op6_quality_rules"](spark, FOLDER).toPandas()
    good = set(quality[quality.kept].doc_id)
    assert kept <= good
    texts = dict(zip(rows.doc_id, rows.text, strict=True))
    classes = brute_classes([(i, texts[i]) for i in sorted(good)])
    assert all(len(kept & c) <= 1 for c in classes)
    assert sum(bool(kept & c) for c in classes) >= 0.98 * len(classes)
    assert corpus_pipeline.ORACLE_SQL is None
