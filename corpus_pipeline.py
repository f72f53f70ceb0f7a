"""A corpus pipeline: language, quality, near duplicates, packing.

Each stage takes (spark, docs, folder) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import stages
from kinweave.session import scratch, stage

STAGES = [
    ("language", stages.known_language),
    ("quality", stages.good_quality),
    ("near_duplicates", stages.one_of_each_class),
    ("packing", stages.packed),
]

#: Support vector machines, the minwise process and best fit cannot be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the packed pieces of the documents that stay.

    What a stage writes on its way is deleted when its result is written, and that when the next stage has read it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as whole:
        for name, work in STAGES:
            with scratch(spark) as made:
                docs = made.keep(stage(work(spark, docs, sf_dir), f"pipeline-{name}"))
        return whole.keep(docs)
