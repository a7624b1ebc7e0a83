"""Output names, statuses, the manifest, exit codes, and the writing of one file for each document."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.formats import EXIT_CODES

SUFFIX = {"md": "md", "json": "json", "text": "txt"}
SKIPS = ("unsupported_format", "no_text_layer")
STATUS = ("ord", "source", "output", "status", "reason", "format", "ocr", "counts_as", "message")


def short_target(relative: Column, suffix: str) -> Column:
    """The relative path with its last extension replaced."""
    stem = F.regexp_replace(relative, r"(?s)(?<=[^/])\.[^./]*$", "")
    return F.concat(stem, F.lit(f".{suffix}"))


def with_targets(jobs: DataFrame, suffix: str, relative: str = "relative") -> DataFrame:
    """Adds target; inputs whose short names collide keep their extension before the new one."""
    short = short_target(F.col(relative), suffix)
    jobs = jobs.withColumn("__short", short)
    several = F.count("*").over(W.partitionBy("__short")) > 1
    return jobs.withColumn("target", F.when(several, F.concat(F.col(relative), F.lit(f".{suffix}"))).otherwise(F.col("__short"))).drop("__short")


def exit_code(reason: Column) -> Column:
    out = F.lit(1)
    for name, code in EXIT_CODES.items():
        out = F.when(reason == name, code).otherwise(out)
    return F.when(reason.isNotNull(), out)


def outcome(reason: Column, discovered: Column) -> Column:
    skipped = discovered & reason.isin(*SKIPS)
    return F.when(reason.isNull(), "extracted").when(skipped, "skipped").otherwise("error")


def statuses(docs: DataFrame, problems: DataFrame | None = None, output: str | None = None) -> DataFrame:
    """STATUS for every problem of the listing, then every document, in order. counts_as tells
    a folder that couldn't be read (an error that counts as a skip) from other errors."""
    reason = F.col("reason")
    status = outcome(reason, F.col("discovered"))
    own = docs.select(
        F.lit(1).alias("part"), F.col("ord"), F.col("doc_id").cast("string").alias("source"),
        F.when(status == "extracted", F.col(output) if output else F.lit(None).cast("string")).alias("output"), status.alias("status"),
        reason.alias("reason"), "format", "ocr", status.alias("counts_as"), (F.col("message") if "message" in docs.columns else F.lit(None).cast("string")).alias("message"),
    )
    if problems is not None:
        listed = problems.select(
            F.lit(0).alias("part"), "ord", "source", F.lit(None).cast("string").alias("output"), F.lit("error").alias("status"),
            F.lit("io_error").alias("reason"), F.lit(None).cast("string").alias("format"), F.lit(False).alias("ocr"),
            F.when(F.col("skip"), "skipped").otherwise("error").alias("counts_as"), "message",
        )
        own = listed.unionByName(own)
    return own.select(F.struct("part", "ord").alias("ord"), *STATUS[1:])


def roll_up(found: DataFrame) -> DataFrame:
    """(extracted, skipped, failed, exit_code), one row: the first failure's code, else, if
    nothing was extracted, the first skip's, else 0."""
    code = exit_code(F.col("reason"))
    first = lambda kind: F.min_by(F.when(F.col("counts_as") == kind, code), F.when(F.col("counts_as") == kind, F.col("ord")))
    counts = [F.count_if(F.col("counts_as") == k).alias(v) for k, v in (("extracted", "extracted"), ("skipped", "skipped"), ("error", "failed"))]
    return found.agg(*counts, first("error").alias("f"), first("skipped").alias("s")).select(
        "extracted", "skipped", "failed", F.coalesce("f", F.when(F.col("extracted") == 0, F.col("s")), F.lit(0)).cast("int").alias("exit_code")
    )


def summary(extracted: int, skipped: int, failed: int) -> str:
    line = f"{extracted} extracted, {skipped} skipped" + (f", {failed} failed" if failed else "")
    return f"✓ {line}" if extracted and not failed else line


def manifest(found: DataFrame) -> str:
    """All statuses as a JSON array in order. It is one document by its nature; at scale keep
    the statuses as a table."""
    rows = []
    for row in found.orderBy("ord").toLocalIterator():
        one = {"source": row["source"], "output": row["output"], "status": row["status"]}
        if row["reason"] is not None:
            one["reason"] = row["reason"]
        one["format"] = row["format"]
        rows.append(one | ({"ocr": True} if row["ocr"] else {}))
    return json.dumps(rows, indent=2, ensure_ascii=False) + "\n"


def write_files(outputs: DataFrame, root: str) -> DataFrame:
    """Writes (target, output) rows as files below root, in tasks; gives (target, error). A file
    is written beside its place and moved there, so a task that runs again does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors: list[str | None] = []
            for target, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = os.path.join(root, target)
                try:
                    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
                    aside = f"{path}.{os.getpid()}.part"
                    with open(aside, "w", encoding="utf-8", newline="") as f:
                        f.write(body)
                    os.replace(aside, path)
                    errors.append(None)
                except OSError as e:
                    errors.append(str(e))
            yield pa.record_batch([batch.column(0), pa.array(errors, pa.string())], ["target", "error"])

    return outputs.select("target", "output").mapInArrow(run, "target string, error string")
