"""Canonical exact digests of documents.

Canonical text: NFC, case folding, NFC again, white space runs to one space, ends trimmed.
Texts with equal 128-bit xxh3 digests are compared byte by byte before they share a group,
so a digest collision can't join two documents.

Defined results: null text counts as empty text, and all empty texts form one group; a row
with a null doc_id has a digest but is left out of the groups; a doc_id that repeats counts
once for each distinct canonical text, so a repeated row changes nothing; texts of any length are
read whole; ties go to the smallest doc_id; further columns,
also ones named like the results, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, id_column

WIDTH = 16


def canonical(text: str | None) -> str:
    text = text or ""
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    return " ".join(folded.split())


def _digest(text: bytes, width: int) -> bytes:
    return xxhash.xxh3_128_digest(text)[:width]


def _digests(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest = [_digest(canonical(t).encode("utf-8", "replace"), width) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(digest, pa.binary())], ["doc_id", "digest"])

    return run


def _canonical_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                texts = [canonical(t).encode("utf-8", "replace") for t in part.column(1).to_pylist()]
                digest = [_digest(t, width) for t in texts]
                yield pa.record_batch(
                    [part.column(0), pa.array(digest, pa.binary()), pa.array(texts, pa.large_binary()).cast(pa.binary())],
                    ["doc_id", "digest", "canon"],
                )

    return run


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, digest) for every row."""
    texts = docs.select(id_column(docs), docs["text"].cast("string").alias("text"))
    return texts.mapInArrow(_digests(width), "doc_id long, digest binary")


def exact_groups(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, digest as hex, group_id, group_size): the smallest doc_id with the same
    canonical text, and how many documents have it. `width` bytes of the digest are used.

    All texts are read into digests once, and of these come groups by sums with map-side parts.
    Texts whose digest occurs more than once are read again and collapse map-side by their full
    bytes. A digest that turns out to stand for several texts is grouped by those bytes.
    """
    marks = cut(fingerprints(docs, width).where("doc_id is not null").distinct())
    groups = cut(marks.groupBy("digest").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size")))
    several = groups.where("group_size > 1").select("digest")
    shared_ids = marks.join(several, "digest", "left_semi").select("doc_id").distinct()
    texts = docs.select(id_column(docs), docs["text"].cast("string").alias("text"))
    suspects = (
        texts.join(shared_ids, "doc_id", "left_semi")
        .mapInArrow(_canonical_rows(width), "doc_id long, digest binary, canon binary")
        .join(several, "digest", "left_semi")
    )
    collided = cut(suspects.select("digest", "canon").distinct().groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    result = marks.join(groups, "digest")
    if not collided.isEmpty():
        own = suspects.join(collided, "digest", "left_semi").distinct()
        apart = own.join(own.groupBy("digest", "canon").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size")), ["digest", "canon"])
        result = result.join(collided, "digest", "left_anti").union(apart.select("digest", "doc_id", "group_id", "group_size"))
    return result.select("doc_id", F.lower(F.hex("digest")).alias("digest"), "group_id", "group_size")
