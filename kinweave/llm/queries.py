"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import table
from ..session import stage
from . import (
    archives,
    bpe,
    chat,
    fingerprint,
    language,
    lines,
    neardup,
    packing,
    quality,
    repair,
    resample,
    sql,
    tokens,
    topk,
)
from .common import crc32_fold
from .registry import query
from .stages import byte_bpe_path


@query("op8_language_id")
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    fold = F.coalesce(crc32_fold("doc_id", 4) == 2, F.lit(False))
    model = language.fit(docs.where(~fold))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", fold.alias("held_out"), "found.lang_pred", "found.score")


@query("op6_quality_rules", sql.QUALITY_RULES)
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return lines.judge(table(spark, folder, "documents").select("doc_id", "text", "source"), ["doc_id"])


@query("op10_warc_archives")
def op10_warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    return archives.archive(table(spark, folder, "pages"))


@query("op7_chat_format", sql.CHAT_FORMAT)
def op7_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], turns.schema)
    return chat.read_back(*chat.write(turns.unionByName(added)))


@query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held = F.coalesce(crc32_fold("doc_id", 5) == 0, F.lit(False))
    labels = table(spark, folder, "labels").select("doc_id", "quality").where(~held)
    found = quality.score(docs, quality.fit(docs, labels))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")


@query("op2_document_fingerprints")
def op2_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.compare_with_next(table(spark, folder, "documents"))


@query("op5_bpe_round_trip")
def op5_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digest(table(spark, folder, "documents"), byte_bpe_path())


@query("op4_token_records")
def op4_token_records(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.round_trip(table(spark, folder, "documents"), byte_bpe_path())


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return packing.pack(tokens.count_tokens(docs, byte_bpe_path(), ["doc_id"]))


@query("op3_minhash_near_duplicates")
def op3_minhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.classes(table(spark, folder, "documents"))


@query("op11_importance_resampling", sql.IMPORTANCE_RESAMPLING)
def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = resample.resample(docs, table(spark, folder, "benchmark").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_exact_top_k", sql.EXACT_TOP_K)
def op12_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.whole_numbers(table(spark, folder, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


@query("op13_conversation_repair", sql.CONVERSATION_REPAIR)
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    steps = stage(repair.repair(repair.damage(turns)), "repaired")
    return repair.of_all(turns, repair.report(steps))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
