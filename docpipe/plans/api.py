"""What a user calls: convert, chunk, run_batch, register_views.

    convert(spark, ["report.docx"], format="md")           DataFrame (doc_id, output)
    chunk(spark, ["handbook.pdf"], size=800, overlap=80)   DataFrame of chunks
    run_batch(spark, ["inbox"], recursive=True, output="out", manifest="out/manifest.json")
    register_views(spark, files)                           SQL over files, documents, blocks, chunks, statuses
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass
from typing import TextIO

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import chunk as C, render, status
from ..operators.extract import extract
from ..sources import formats, listing


def documents(spark: SparkSession, inputs: Iterable[str], recursive: bool = False, pages: str | None = None, full: bool = False, ocr=None) -> tuple[DataFrame, DataFrame]:
    """Documents and listing problems."""
    if pages:
        formats.page_range(pages)  # a usage error comes before any file is read
    jobs, problems = listing.list_inputs(spark, inputs, recursive)
    return extract(listing.read_jobs(jobs), pages, full, ocr), problems


def convert(spark: SparkSession, inputs: Iterable[str], format: str = "md", metadata: bool = False, recursive: bool = False, pages: str | None = None, ocr=None) -> DataFrame:
    return render.rendered(documents(spark, inputs, recursive, pages, ocr=ocr)[0], format, metadata)


def chunk(spark: SparkSession, inputs: Iterable[str], size: int = C.SIZE, overlap: int = C.OVERLAP, recursive: bool = False, pages: str | None = None) -> DataFrame:
    return C.chunks(documents(spark, inputs, recursive, pages)[0], size, overlap)


@dataclass
class Batch:
    """What a batch did; statuses is a table with a row for each input, as often as it was named."""

    extracted: int
    skipped: int
    failed: int
    exit_code: int
    summary: str
    statuses: DataFrame


def run_batch(
    spark: SparkSession, inputs: Iterable[str], output: str | None = None, format: str = "md", metadata: bool = False, recursive: bool = False,
    pages: str | None = None, chunk_size: int | None = None, chunk_overlap: int = C.OVERLAP, manifest: str | None = None, ocr=None, printed: TextIO | None = None,
) -> Batch:
    """Extracts all inputs, writes a file for each document below output (or to it, for a single
    named input), and the statuses as a manifest. Every file is parsed once. Without an output the
    documents go to `printed`, if it is given, in the inputs' order."""
    inputs = list(inputs)
    if pages:
        formats.page_range(pages)
    jobs, problems = listing.list_inputs(spark, inputs, recursive)
    jobs = status.with_targets(jobs, status.SUFFIX[format])
    # An input that is named twice is two jobs: they go by their number, not by their path.
    found = extract(listing.read_jobs(jobs), pages, ocr=ocr).join(jobs.select("ord", "target"), "ord").withColumnRenamed("doc_id", "source").withColumn("doc_id", F.col("ord"))
    found = found.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if chunk_size is None:
            text = render.rendered(found, format, metadata)
        else:
            text = C.rendered(C.chunks(found, chunk_size, chunk_overlap), format)
        to_dir = recursive or jobs.count() > 1
        done = found.withColumn("__out", F.lit(None).cast("string"))
        if output is not None:
            root, name = (output, None) if to_dir else os.path.split(output)
            placed = text.join(found.select("doc_id", F.lit(name).alias("target") if name else "target"), "doc_id")
            written = status.write_files(placed, root).persist(StorageLevel.MEMORY_AND_DISK)
            errors = written.where("error is not null").groupBy("target").agg(F.min("error").alias("__error"))
            place = F.concat(F.lit(os.path.join(output, "")), "target") if to_dir else F.lit(output)
            done = found.withColumn("__out", place)
            done = done.join(errors, "target", "left") if to_dir else done.crossJoin(errors.agg(F.min("__error").alias("__error")))
            lost = F.col("reason").isNull() & F.col("__error").isNotNull()
            done = done.withColumn("message", F.when(lost, F.col("__error")).otherwise(F.col("message"))).withColumn("reason", F.when(lost, "io_error").otherwise(F.col("reason")))
        elif printed is not None:
            for row in text.orderBy("doc_id").toLocalIterator():
                printed.write(row["output"])
        rows = status.statuses(done.withColumn("doc_id", F.col("source")), problems, "__out").persist(StorageLevel.MEMORY_AND_DISK)
        total = status.roll_up(rows).first()
        if manifest is not None:
            os.makedirs(os.path.dirname(manifest) or ".", exist_ok=True)
            with open(manifest, "w", encoding="utf-8") as f:
                f.write(status.manifest(rows))
    finally:
        found.unpersist()
    return Batch(total["extracted"], total["skipped"], total["failed"], total["exit_code"], status.summary(total["extracted"], total["skipped"], total["failed"]), rows)


def register_views(spark: SparkSession, files: DataFrame, size: int = C.SIZE, overlap: int = C.OVERLAP) -> None:
    """SQL views files, documents, blocks, chunks and statuses over rows (doc_id, content,
    format, ...)."""
    docs = extract(files)
    for name, missing in (("ord", F.lit(None).cast("long")), ("discovered", F.lit(True))):
        if name not in docs.columns:
            docs = docs.withColumn(name, missing)
    files.createOrReplaceTempView("files")
    docs.createOrReplaceTempView("documents")
    docs.select("doc_id", F.posexplode("blocks").alias("block_idx", "b")).select("doc_id", "block_idx", "b.*").createOrReplaceTempView("blocks")
    C.chunks(docs, size, overlap).createOrReplaceTempView("chunks")
    status.statuses(docs).createOrReplaceTempView("statuses")
