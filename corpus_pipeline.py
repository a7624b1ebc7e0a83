"""A corpus pipeline: documents in, token ids out, five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows
as Parquet in the folder that the cluster names in spark.checkpoint.dir and reads them again
for the next stage, so a lost executor costs tasks of one stage at most. A stage's folder goes
when the next one is written; the last stays, as the result is read from it.

Defined results, stage by stage (all but the last return the columns of documents, also further
ones with any name, and judge each row by itself unless said otherwise):
  quality_classifier  rows whose score is below KEEP go; without labels of both kinds all stay; null
                      texts count as empty, null source and lang as values of their own
  near_dedup          of each group the smallest (doc_id, text) stays, and one of rows that repeat
                      both; null doc_ids, null texts and texts without words stay
  substring_dedup     later occurrences of passages of 50 words and more are cut out of the text, and
                      a document of which no word is left goes; n_chars follows the text; null
                      doc_ids and texts stay as they are
  decontamination     documents that leak a benchmark item go, by doc_id; null doc_ids and texts stay
  tokenization        a row for each row: null text has null tokens, empty text none
Texts of any length pass whole; empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docpipe.llm import bpe, decontaminate, minhash, quality, substrings
from docpipe.llm.common import drop, shared_dir, tables


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, *tables(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, *tables(spark, sf_dir, "benchmark"))


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("tokenization", tokenization),
]

ORACLE_SQL = None  # no stage but the last filters by rules that SQL could express


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            drop(spark, f"{folder}/{before}")
        before = name
    return docs
