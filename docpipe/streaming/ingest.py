"""Incremental ingestion: new files become chunks as they arrive, changed documents replace
their chunks. Nothing keeps state between batches but the output itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunk import OVERLAP, SIZE, chunks
from ..operators.extract import extract
from ..sources.listing import with_format

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """(doc_id, content, format) of the files below root as they appear."""
    files = (
        spark.readStream.format("binaryFile").schema(BINARY)
        .option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(root)
    )
    return with_format(files.select(F.regexp_replace("path", "^file:/*", "/").alias("doc_id"), "content"))


def chunk_stream(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    return chunks(extract(files), size, overlap)


def changed(new: DataFrame, old: DataFrame) -> DataFrame:
    """The chunks of new whose (doc_id, hash) old doesn't have: only they need embedding."""
    return new.join(old.select("doc_id", "hash").distinct(), ["doc_id", "hash"], "left_anti")


def run_ingest(files: DataFrame, target: str, checkpoint: str, size: int = SIZE, overlap: int = OVERLAP) -> StreamingQuery:
    """Appends the chunks of each batch to target as Parquet in a folder of the batch's number,
    which a repeated batch overwrites; ends when all that is there has been read."""

    def write(batch: DataFrame, number: int) -> None:
        chunks(extract(batch), size, overlap).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """Chunks of each document's newest version."""
    found = spark.read.parquet(target)
    newest = found.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return found.join(newest, ["doc_id", "batch"], "left_semi").drop("batch")
