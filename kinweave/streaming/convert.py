"""Chunk-wise conversion of a growing folder of CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.tables import CSV_OPTIONS, read_csv


def csv_folder_to_parquet(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    schema: T.StructType,
    files_per_chunk: int = 100,
    multiline: bool | None = True,
) -> None:
    """Convert the files not converted before, in chunks, under one fixed schema.

    The checkpoint records finished chunks, so a run that was interrupted goes on where it stopped
    and no file is converted twice. With ``multiline`` True each file is read by one task; with False files without line
    breaks in fields are split; with None all are split, and each chunk is a folder ``chunk=<number>`` of the
    target, which a repeated run of the chunk replaces.
    """
    if multiline is None:
        _by_chunks(spark, source, target, checkpoint, schema, files_per_chunk)
        return
    rows = (
        spark.readStream.schema(schema)
        .options(**CSV_OPTIONS, multiLine=multiline)
        .option("maxFilesPerTrigger", files_per_chunk)
        .csv(source)
    )
    query = (
        rows.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .option("compression", "snappy")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _by_chunks(spark: SparkSession, source: str, target: str, checkpoint: str, schema: T.StructType, files_per_chunk: int) -> None:
    # only the names of the files are streamed; their contents are read by ranges
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    names = files.option("maxFilesPerTrigger", files_per_chunk).load(source).select("path")

    def convert(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.collect()]  # at most files_per_chunk
        if paths:
            rows = read_csv(spark, paths, schema)
            rows.write.mode("overwrite").option("compression", "snappy").parquet(f"{target}/chunk={number}")

    query = names.writeStream.foreachBatch(convert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
