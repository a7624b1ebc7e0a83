"""Files as rows.

read_tree() is the way for large stores: Spark lists and splits the files. list_inputs() takes
named files and folders as a command line would, hidden files included; the listing runs on the
driver, the reading in tasks, so the paths must be visible to the executors.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .detect import HEAD, detect, extension

JOBS = "ord long, path string, relative string, discovered boolean"
PROBLEMS = "ord long, source string, message string, skip boolean"
FILES = "doc_id string, relative string, discovered boolean, ord long, content binary, error string"


def with_format(files: DataFrame) -> DataFrame:
    """Adds format, from content and doc_id (the path)."""
    return files.withColumn("format", detect(F.substring("content", 1, HEAD), extension(F.col("doc_id"))))


def read_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Everything below a folder of any file system that Spark reads; names that start with a
    point or an underscore are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    base = os.path.join(root.removeprefix("file://"), "")
    files = found.select(
        path.alias("doc_id"), F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path).alias("relative"),
        F.lit(True).alias("discovered"), F.lit(None).cast("long").alias("ord"), "content", F.lit(None).cast("string").alias("error"),
    )
    return with_format(files)


def _walk(root: str, folder: str, jobs: list, problems: list) -> None:
    try:
        entries = list(os.scandir(folder))
    except OSError as e:
        problems.append((folder, str(e), True))
        return
    for entry in entries:
        if entry.is_dir(follow_symlinks=False):
            _walk(root, entry.path, jobs, problems)
        elif entry.is_file(follow_symlinks=False):
            jobs.append((entry.path, os.path.relpath(entry.path, root), True))


def list_inputs(spark: SparkSession, inputs: Iterable[str], recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(JOBS, PROBLEMS): files in the order of their paths' parts, and what couldn't be listed."""
    jobs: list[tuple] = []
    problems: list[tuple] = []
    for path in inputs:
        if not os.path.exists(path):
            problems.append((path, "no such file", False))
        elif not os.path.isdir(path):
            jobs.append((path, os.path.basename(path), False))
        elif recursive:
            _walk(path, path, jobs, problems)
        else:
            problems.append((path, "a folder is read only recursively", False))
    jobs.sort(key=lambda j: j[0].split("/"))
    return (
        spark.createDataFrame([(k, *j) for k, j in enumerate(jobs)], JOBS),
        spark.createDataFrame([(k, *p) for k, p in enumerate(problems)], PROBLEMS),
    )


def read_jobs(jobs: DataFrame, tasks: int | None = None) -> DataFrame:
    """FILES and format; a file that can't be read has its error instead of content."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                content = error = None
                try:
                    with open(row["path"], "rb") as f:
                        content = f.read()
                except OSError as e:
                    error = str(e)
                one = {"doc_id": row["path"], "relative": row["relative"], "discovered": row["discovered"], "ord": row["ord"], "content": content, "error": error}
                yield pa.RecordBatch.from_pylist([one], _FILES)

    spread = jobs.repartition(tasks or jobs.sparkSession.sparkContext.defaultParallelism)
    return with_format(spread.mapInArrow(read, FILES))


_FILES = pa.schema([("doc_id", pa.string()), ("relative", pa.string()), ("discovered", pa.bool_()), ("ord", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
