"""Quality rules: lines that many documents of a host share, in DataFrame functions only.

A line is normalised (letters lower-cased, digits as 0, white space and punctuation as one blank)
and hashed. For each host (``source``) the distinct documents holding a line are counted, where documents
of equal text count once, so copies do not make their own lines look shared. A line held by at least
``min_documents`` documents and ``host_percent`` percent of the host's documents is removed. A document is kept
unless it fails the base rules or fewer than ``keep_percent`` percent of its words stay.

Near copies do not make their own lines look shared either. Each text has a sketch, the ``SKETCH`` least hashes of
its runs of three words. Near copies mostly share them; texts with a common template share those of the template only. So
a line's documents count at most ``100 / keep_percent`` times their distinct least hashes, divided by ``SKETCH``: pages
with ``keep_percent`` percent of their own beside a template count about in full, near copies as few.

Decisions: words are runs of characters other than blank, tab and the line and page breaks; a null text
has none. A null source is a host of its own. Repeated rows get one verdict each. A line without a letter or
digit is not counted, and stays. Counts cover all rows; no line, document or host is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import left_join_unique
from ..session import scratch, stage

#: Base rules (fixed values of the contract).
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Limits of the method.
MIN_DOCUMENTS = 20
HOST_PERCENT = 10
KEEP_PERCENT = 30

#: Least hashes of each text (fixed value).
SKETCH = 8

_SPACES = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, also where Catalyst moves the expression about."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeated(hashes: Column) -> Column:
    """Positions in windows of three that occur twice or more: windows sorted by hash, equal neighbours."""
    at = lambda i: F.get(hashes, i)
    starts = F.when(F.size(hashes) >= 3, F.sequence(F.lit(0), F.size(hashes) - 3)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("i")))
    twice = _let(
        F.sort_array(windows),
        lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])),
    )
    covered = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return F.size(F.array_distinct(covered)).cast("long")


def _with_base(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Word and line counts of each text; one pass without a shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, _SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _let(F.transform(w, lambda x: F.xxhash64(x)), _repeated).alias("n_repeat_words"),
        ),
    )
    counted = docs.select(
        *keep,
        of_words.alias("_c"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    failed = (F.col("_c.n_words") < MIN_WORDS) | (
        100 * F.col("_c.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_c.n_words")
    )
    return counted.select(*keep, "_c.*", "n_symbols", "n_dup_lines", failed.alias("base_failed"))


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{Nd}", "0"), r"[^\p{L}\p{M}0]+", " "))


def _text_key() -> Column:
    """128 bits of a text: two texts share it only if they are equal."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _sketch() -> Column:
    """The least hashes of a text's runs of three words; a text of fewer runs is filled up with hashes of its own."""
    words = F.split(F.coalesce(F.col("text"), F.lit("")), _SPACES)

    def runs(h: Column) -> Column:
        starts = F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0)))
        return F.transform(starts, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))

    made = F.sort_array(_let(F.transform(words, lambda w: F.xxhash64(w)), runs))
    least = F.array_distinct(F.slice(made, 1, 8 * SKETCH))  # a few more, as runs may repeat
    own = F.array(*[F.xxhash64(_text_key(), F.lit(k)) for k in range(SKETCH)])
    return _let(least, lambda x: F.when(F.size(x) >= SKETCH, F.slice(x, 1, SKETCH)).otherwise(F.slice(F.concat(x, own), 1, SKETCH)))


def _lines(docs: DataFrame) -> DataFrame:
    """(host, doc, line, words): the lines of each text with their words."""
    texts = docs.select(
        F.coalesce("source", F.lit("")).alias("host"),
        _text_key().alias("doc"),
        F.split(F.coalesce(F.col("text"), F.lit("")), "\n").alias("_all"),
    )
    # keys are made before the lines are dealt out: once for each text
    split = texts.select("host", "doc", F.explode("_all").alias("_line"))
    named = split.select(
        "host",
        "doc",
        F.xxhash64(_normal(F.col("_line"))).alias("line"),
        F.size(F.filter(F.split("_line", _SPACES), lambda w: w != "")).alias("words"),
        (_normal(F.col("_line")) == "").alias("_blank"),
    )
    return named.where("words > 0 and not _blank").drop("_blank")


def line_table(docs: DataFrame) -> DataFrame:
    """(host, doc, line, words): each line hash of each text on a host, written once.

    ``words`` counts every occurrence in every copy of the text on that host.
    """
    return stage(_lines(docs).groupBy("host", "doc", "line").agg(F.sum("words").alias("words")), "lines")


def text_table(docs: DataFrame) -> DataFrame:
    """(host, doc, copies, sketch): each text of a host with the number of its rows."""
    key = docs.select(F.coalesce("source", F.lit("")).alias("host"), _text_key().alias("doc"), _sketch().alias("sketch"))
    held = key.groupBy("host", "doc").agg(F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"))
    return stage(held, "texts")


def frequent_lines(
    lines: DataFrame,
    texts: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    host_percent: int = HOST_PERCENT,
    keep_percent: int = KEEP_PERCENT,
) -> DataFrame:
    """(host, line, documents) of every line above the limits of its host, near copies counted by their sketches."""
    held = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents")).where(
        F.col("documents") >= min_documents
    )
    hosts = texts.groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    enough = (F.col("documents") >= min_documents) & (100 * F.col("documents") >= host_percent * F.col("of"))
    # both sides hold one row for each host or line of enough documents
    often = stage(held.join(hosts, "host").where(enough), "often-held-lines")
    hit = left_join_unique(lines, often.select("host", "line", F.lit(True).alias("hit")), ["host", "line"])
    met = hit.where("hit").select("host", "doc", "line").join(texts, ["host", "doc"])
    least = met.select("host", "line", F.explode("sketch").alias("least")).distinct()
    differ = least.groupBy("host", "line").agg(F.count(F.lit(1)).alias("differ"))
    most = F.ceil(F.col("differ") * 100 / (SKETCH * max(keep_percent, 1)))
    counted = often.join(differ, ["host", "line"]).withColumn("documents", F.least("documents", most))
    return counted.where(enough).select("host", "line", "documents")


def removed_words(lines: DataFrame, texts: DataFrame, frequent: DataFrame) -> DataFrame:
    """(host, doc, removed): words in frequent lines of one copy of each text that has any."""
    hit = left_join_unique(lines, frequent.select("host", "line", F.lit(True).alias("hit")), ["host", "line"])
    sums = hit.where("hit").groupBy("host", "doc").agg(F.sum("words").alias("in_all"))
    return sums.join(texts, ["host", "doc"]).select(
        "host", "doc", (F.col("in_all") / F.col("copies")).cast("long").alias("removed")
    )


def judge(
    docs: DataFrame,
    keep: list[str],
    min_documents: int = MIN_DOCUMENTS,
    host_percent: int = HOST_PERCENT,
    keep_percent: int = KEEP_PERCENT,
) -> DataFrame:
    """``keep`` columns of every row, the base counts, removed_words, base_failed and kept.

    Texts themselves are not shuffled: only line hashes and text keys are.
    """
    with scratch(docs.sparkSession) as made:
        lines, texts = line_table(docs), text_table(docs)
        frequent = stage(frequent_lines(lines, texts, min_documents, host_percent, keep_percent), "frequent-lines")
        gone = made.keep(stage(removed_words(lines, texts, frequent), "removed-words"))
    own = docs.withColumns({"_host": F.coalesce("source", F.lit("")), "_doc": _text_key()})
    base = _with_base(own, list(dict.fromkeys([*keep, "_host", "_doc"])))
    found = left_join_unique(
        base, gone.select(F.col("host").alias("_host"), F.col("doc").alias("_doc"), "removed"), ["_host", "_doc"]
    )
    removed = F.coalesce("removed", F.lit(0).cast("long"))
    kept = ~F.col("base_failed") & (100 * (F.col("n_words") - removed) >= keep_percent * F.col("n_words"))
    return found.withColumns({"removed_words": removed, "kept": kept}).drop("_host", "_doc", "removed")
