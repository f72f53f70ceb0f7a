"""The stages of the corpus pipeline, each by one of the operators.

Stages keep the columns of ``documents`` and drop others. Rows are judged one by one; equal rows share a verdict,
but of a class of near duplicates one row stays, whatever its columns hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, lines, neardup, packing, tokens
from .common import DOCUMENT_COLUMNS

#: A text is taken for one of the learnt languages if it is at least this share as like one as their own texts are.
LEAST_FAMILIARITY = 0.4


def byte_bpe_path() -> str:
    """The public vocabulary file of the token stages and queries; installed on every node."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with letters in one of the languages that rows with a ``lang`` teach.

    A text in a script or language that no such row has is unlike all of them and goes.
    """
    own = docs.select(*DOCUMENT_COLUMNS)
    found = language.identify(own, language.fit(own))
    keep = (F.col("found.lang_pred") != language.UNDETERMINED) & (F.col("found.familiarity") >= LEAST_FAMILIARITY)
    return found.where(keep).select(*DOCUMENT_COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the base rules and are not made of lines their host repeats."""
    own = docs.select(*DOCUMENT_COLUMNS)
    return lines.judge(own, DOCUMENT_COLUMNS).where("kept").select(*DOCUMENT_COLUMNS)


def one_of_each_class(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near duplicates: the one that names it, with the least id."""
    return neardup.representatives(docs.select(*DOCUMENT_COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of the documents in bins of the permitted lengths, by tokens."""
    return packing.pack(tokens.count_tokens(docs, byte_bpe_path(), ["doc_id"]))
