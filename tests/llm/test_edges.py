"""Every operator and stage over awkward rows, an empty table, and extra columns with clashing names."""

import corpus_pipeline
import pytest
from kinweave.llm import archives, bpe, chat, fingerprint, language, lines, neardup, packing, quality, stages, tokens
from pyspark.sql import functions as F

PATH = stages.byte_bpe_path()


def _language(spark, docs):
    return language.identify(docs, language.fit(docs)).select("doc_id", "found.*")


def _quality(spark, docs):
    labels = docs.select("doc_id", F.when(F.col("doc_id") < 5, 1).alias("quality"))
    return quality.score(docs, quality.fit(docs, labels))


OPERATORS = {
    "language": _language,
    "quality": _quality,
    "fingerprint": lambda spark, docs: fingerprint.compare_with_next(docs),
    "neardup": lambda spark, docs: neardup.classes(docs),
    "tokens": lambda spark, docs: tokens.round_trip(docs, PATH),
    "bpe": lambda spark, docs: bpe.digest(docs, PATH),
    "lines": lambda spark, docs: lines.judge(docs, ["doc_id"]),
    "packing": lambda spark, docs: packing.pack(tokens.count_tokens(docs, PATH, ["doc_id"]), permitted=(64, 256)),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_operator_over_awkward_rows(spark, documents, name):
    plain = OPERATORS[name](spark, documents()).collect()
    clash = OPERATORS[name](spark, documents(extra=True)).collect()
    assert len({r["doc_id"] for r in plain}) == 9  # eight ids and the missing one
    if name != "packing":
        assert len(plain) == 10
    key = repr
    assert sorted(map(key, plain)) == sorted(map(key, clash))


@pytest.mark.parametrize("name", list(OPERATORS))
def test_operator_over_an_empty_table(spark, documents, name):
    assert OPERATORS[name](spark, documents([])).collect() == []


@pytest.mark.parametrize("name, work", corpus_pipeline.STAGES)
def test_stage_over_awkward_rows(spark, documents, name, work):
    from kinweave.llm.common import DOCUMENT_COLUMNS

    for docs in (documents(extra=True), documents([])):
        got = work(spark, docs, "")
        if name != "packing":
            assert got.columns == DOCUMENT_COLUMNS
        got.collect()


def test_language_rejects_texts_without_letters(spark, documents):
    kept = {r["doc_id"] for r in stages.known_language(spark, documents(), "").collect()}
    assert not kept & {3, 4, 5} and {1, 2, None} <= kept


def test_every_language_is_learnt(spark):
    """More languages than take part in full: also the rarest is given back."""
    letters = [chr(0x4E00 + 40 * k) + chr(0x4E07 + 40 * k) + chr(0x4E11 + 40 * k) for k in range(80)]
    rows = [
        (100 * k + i, " ".join(letters[k][j % 3] * (1 + (i + j) % 3) for j in range(12)), f"x{k:02d}")
        for k in range(80)
        for i in range(2 if k == 79 else 3)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert len(model.langs) == 80 and len(model.pairs) < 80 * 79 // 4
    got = language.identify(docs, model).select("lang", "found.*").collect()
    assert all(r["lang_pred"] == r["lang"] for r in got if r["lang"] == "x79")
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got)


def test_one_row_of_each_class_stays(spark, documents):
    kept = [r["doc_id"] for r in stages.one_of_each_class(spark, documents(), "").collect()]
    assert kept.count(1) == 1 and 2 not in kept and None not in kept
    # rows 3 and 4 are equal texts (a null is empty); others stand alone
    assert sorted(x for x in kept if x != 1) == [3, 5, 6, 7, 8]


def test_chat_and_pages_over_awkward_rows(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "a\\<b[c"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, None, None, "<|end|>\n"),
         (None, 0, "assistant", "x"), (3, 0, "ro\nle", "y")],
        "conv_id long, turn long, role string, text string",
    )
    got = {r["conv_id"]: r for r in chat.read_back(*chat.write(turns)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["n_examples"] == 2 and got[1]["loss_chars"] == 0
    assert got[None]["loss_chars"] == 1 and got[3]["n_examples"] == 0
    assert chat.read_back(*chat.write(turns.limit(0))).collect() == []
    pages = spark.createDataFrame(
        [(5, "http://x y", "a"), (3, None, "a"), (None, "u", "a"), (4, "u", None), (7, "u", ""), (3, "v", "a")],
        "page_id long, url string, html string",
    )
    rows = archives.archive(pages).collect()
    assert len(rows) == 6
    assert [r["page_id"] for r in rows if r["record_type"] == "response"].count(3) == 1
    assert {r["page_id"]: r["refers_to"] for r in rows if r["record_type"] == "revisit"} == {5: 3, None: 3, 3: 3, 7: 4}
    assert archives.archive(pages.limit(0)).collect() == []
