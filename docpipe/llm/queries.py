"""One query for each operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, fingerprint, htmltree, lid, minhash, quality, substrings, toxicity
from .common import tables

SPACES = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    (messages,) = tables(spark, sf_dir, "conversations")
    return chat.render(chat.fold(chat.log_of_messages(messages)))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return substrings.repeated_spans(docs)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    return quality.score(docs, quality.train(docs, labels))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(*tables(spark, sf_dir, "documents", "benchmark"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return lid.identify(docs, lid.train(docs))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return bpe.encode(docs)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return minhash.near_groups(docs).select("doc_id", "keep_id", "group_size", "n_links")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(*tables(spark, sf_dir, "documents", "labels"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups only: SQL has no digest of 128 bits to compare with."""
    (docs,) = tables(spark, sf_dir, "documents")
    return fingerprint.exact_groups(docs).select("doc_id", "group_id", "group_size")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    (pages,) = tables(spark, sf_dir, "pages")
    return htmltree.extract(pages, htmltree.train(pages))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat, op2_repeats, op3_quality, op4_decontaminate, op5_language, op6_bpe, op7_near_duplicates, op8_toxicity, op9_fingerprint, op10_html)
}

ORACLE: dict[str, str] = {
    "op1_chat": chat.ORACLE,
    "op9_fingerprint": f"""
with c as (
  select distinct doc_id, trim(regexp_replace(replace(lower(nfc_normalize(coalesce(text, ''))), 'ß', 'ss'), '{SPACES}', ' ', 'g')) as canon
  from documents where doc_id is not null
)
select doc_id, min(doc_id) over (partition by canon) as group_id, count(*) over (partition by canon) as group_size from c
""",
}
