"""Near-duplicate groups by fast similarity sketching.

Sketch (Dahlgaard, Knudsen and Thorup, "Fast Similarity Sketching", 2017): in round i every
shingle is hashed to one of t bins with a value in [i, i+1); in rounds t to 2t-1 all of them
go to bin i-t, so every coordinate is filled, and one document costs O(n + t log t). Bands of
coordinates give candidates; each is verified by the exact Jaccard index of the shingle sets.

Candidates form a star around the smallest text of a bucket. What the stars leave apart is
compared in a second pass, all against all within the bucket but only across components: a
pair inside a component can change nothing, so the groups are those of all candidate pairs. That
pass works on blocks of BLOCK texts of a bucket, two blocks to a row, and compares whole sketches
(8 bits of each coordinate, so that chance can only add agreements); pairs whose sketches agree in so few coordinates that an index at the
threshold would be 6 standard deviations away are left out, all others are verified.

The unit is a document's text, (doc_id, text_hash): a doc_id with several texts is judged by each
of them. Shingles are three consecutive words, case and punctuation folded. Defined results: null
and empty texts and texts without words belong to no group; a text of one or two words is one
shingle; texts of any length are sketched whole; rows with a null doc_id are ignored; rows that
repeat a doc_id and text are one; of equal texts the one of the smallest (doc_id, text_hash) leads;
further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import connected_components, cut, id_column, perhaps, unused
from .kernel import U, Words, blocks, mix, ngrams, prefix, signed, span

SHINGLE, COORDINATES, BANDS, THRESHOLD, BLOCK = 3, 128, 32, 0.55, 256
_NONE = U(0xFFFFFFFFFFFFFFFF)


def sketch(shingles: np.ndarray, doc: np.ndarray, n_docs: int, t: int = COORDINATES) -> np.ndarray:
    """n_docs x t; every row with a shingle is filled."""
    out = np.full(n_docs * t, _NONE, U)
    for i in range(2 * t):
        if not len(shingles):
            break
        x = mix(shingles ^ U((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        at = doc * t + ((x & U(t - 1)).astype(np.int64) if i < t else i - t)
        x >>= U(8)
        x |= U(i << 56)
        np.minimum.at(out, at, x)
        open_rows = (out.reshape(n_docs, t) == _NONE).any(1)
        keep = open_rows[doc]
        shingles, doc = shingles[keep], doc[keep]
    return out.reshape(n_docs, t)


def bands(rows: np.ndarray, n_bands: int = BANDS) -> np.ndarray:
    n, t = rows.shape
    width = t // n_bands
    out = np.zeros((n, n_bands), U)
    part = rows.reshape(n, n_bands, width)
    for k in range(width):
        out = mix(out ^ part[:, :, k])
    return out ^ mix(np.arange(1, n_bands + 1, dtype=U))


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, texts in blocks(batch.column(2)):
            w = Words(texts)
            h = w.hashes()
            s, doc = ngrams(w, h, SHINGLE)
            rows = sketch(s, doc, len(texts))
            keys, short = bands(rows), (mix(rows) & U(0xFF)).astype(np.uint8)
            sums, again = prefix(h), prefix(mix(h ^ U(0xA5A5A5A5A5A5A5A5)))
            first, end = w.first[:-1], w.first[1:]
            some = np.flatnonzero(end > first)
            first, end = first[some], end[some]
            keys = keys[some]
            offsets = pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32))
            yield pa.record_batch(
                [
                    *(batch.column(k).slice(row, len(texts)).take(pa.array(some)) for k in (0, 1)),
                    pa.array(signed(span(sums, first, end))),
                    pa.array(signed(span(again, first, end))),
                    pa.ListArray.from_arrays(offsets, pa.array(signed(keys.reshape(-1)))),
                    pa.array([x.tobytes() for x in short[some]], pa.binary()),
                ],
                ["doc_id", "text_hash", "d1", "d2", "bands", "sketch"],
            )


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, texts in blocks(batch.column(2)):
            w = Words(texts)
            s, doc = ngrams(w, w.hashes(), SHINGLE)
            order = np.lexsort((s, doc))
            s, doc = s[order], doc[order]
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
            s, doc = s[new], doc[new]
            offsets = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.record_batch(
                [
                    *(batch.column(k).slice(row, len(texts)) for k in (0, 1)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(s))),
                ],
                ["doc_id", "text_hash", "s"],
            )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(id_column(docs), docs["text"].cast("string").alias("text")).where(
        "doc_id is not null and text is not null"
    ).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


NODE = "struct<doc_id: long, text_hash: long>"


def verified(docs: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of the pairs (a, b) of texts, each a struct (doc_id, text_hash), those whose exact Jaccard
    index reaches the threshold; only texts that occur in a pair are read into shingles."""
    pairs = cut(pairs)
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct().select("t.doc_id", "t.text_hash"))
    sets = (
        perhaps(_texts(docs), wanted, "doc_id", "text_hash").join(wanted, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text")
        .mapInArrow(_shingle_rows, "doc_id long, text_hash long, s array<long>")
        .select(F.struct("doc_id", "text_hash").alias("t"), "s")
    )
    left = sets.select(F.col("t").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("t").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a").join(right, "b")
        .select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("jaccard"))
        .where(F.col("jaccard") >= threshold).distinct()
    )


def _across(fewest: int):
    """Pairs of different components whose sketches agree in enough coordinates, of rows of two
    blocks (own, other), each a list of (node, component, sketch)."""

    def table(column: pa.Array, row: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        x = column.slice(row, 1).flatten()
        sketches = np.frombuffer(b"".join(x.field(2).to_pylist()), np.uint8).reshape(len(x), -1)
        part = x.field(1)
        return x.field(0), np.stack([part.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1), sketches

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                node, part, own = table(batch.column(0), row)
                node_, part_, other = table(batch.column(1), row)
                left, right = [], []
                for k in range(len(own)):
                    near = ((own[k] == other).sum(1) >= fewest) & (part[k] != part_).any(1)
                    found = np.flatnonzero(near)
                    left.append(np.full(len(found), k))
                    right.append(found)
                left, right = np.concatenate(left), np.concatenate(right)
                if len(left):
                    yield pa.record_batch([node.take(pa.array(left)), node_.take(pa.array(right))], ["a", "b"])

    return run


def near_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, keep_id, keep_hash, group_size, n_links) for the texts of every group of
    two or more: the group's smallest (doc_id, text_hash), how many texts it has, and the links
    that were verified for this one: to each text compared with it and found near, and for a
    copy (equal in all words) the one to the smallest of its copies."""
    own = ("doc_id", "text_hash")
    node = F.struct(*own)
    rows = _texts(docs).mapInArrow(_sketch_rows, "doc_id long, text_hash long, d1 long, d2 long, bands array<long>, sketch binary")
    sketches = cut(rows)
    # Equal word sequences (128 bits) collapse first, so a text with thousands of copies
    # enters the buckets once.
    same = cut(sketches.groupBy("d1", "d2").agg(F.min(node).alias("t"), F.max(node).alias("last")))
    copies = cut(
        sketches.select(*own, "d1", "d2").join(same.where("t <> last").select("d1", "d2", "t"), ["d1", "d2"])
        .select(node.alias("a"), F.col("t").alias("b")).where("a <> b").distinct()
    )
    first_of = sketches.join(same.select("t.doc_id", "t.text_hash"), [*own], "left_semi").dropDuplicates([*own]).select(node.alias("t"), "bands", "sketch")
    rows = first_of.select(F.explode("bands").alias("band"), "t")
    hubs = cut(rows.groupBy("band").agg(F.min("t").alias("hub"), F.max("t").alias("most")).where("hub < most").select("band", "hub"))
    rows = cut(rows.join(hubs, "band"))
    stars = rows.where("t <> hub").select(F.col("hub").alias("a"), F.col("t").alias("b")).distinct()
    first = cut(verified(docs, stars, threshold).select("a", "b"))
    parts = cut(connected_components(first))
    # Second pass: only buckets that still hold more than one component.
    labelled = rows.select("band", "t").join(parts.withColumnRenamed("node", "t"), "t", "left").withColumn("component", F.coalesce("component", "t"))
    open_bands = cut(
        labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
        .where("lo < hi and n > 2").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("n_blocks"))
    )
    placed = labelled.join(open_bands, "band").join(first_of.select("t", "sketch"), "t").withColumn("block", F.pmod(F.hash("t"), "n_blocks"))
    blocks_of = cut(placed.groupBy("band", "block").agg(F.first("n_blocks").alias("n_blocks"), F.collect_list(F.struct("t", "component", "sketch")).alias("x")))
    a = blocks_of.select("band", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("n_blocks") - 1)).alias("j"), F.col("x").alias("own"))
    b = blocks_of.select("band", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.col("x").alias("other"))
    fewest = max(1, int(COORDINATES * threshold - 6 * (COORDINATES * threshold * (1 - threshold)) ** 0.5))
    rest = (
        a.join(b, ["band", "i", "j"]).select("own", "other").mapInArrow(_across(fewest), f"a {NODE}, b {NODE}")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        .join(stars, ["a", "b"], "left_anti")
    )
    second = verified(docs, rest, threshold).select("a", "b")
    found = cut(first.union(second).distinct())
    parts = connected_components(found)
    # Copies hang on their text's group; they needn't pass through the components.
    leads = copies.select(F.col("b").alias("t")).distinct().join(parts.withColumnRenamed("node", "t"), "t", "full").withColumn("component", F.coalesce("component", "t"))
    leads = cut(leads)
    members = cut(leads.union(copies.withColumnRenamed("b", "t").join(leads, "t").select("a", "component")))
    links = found.select(F.explode(F.array("a", "b")).alias("t")).union(copies.select(F.explode(F.array("a", "b")).alias("t"))).groupBy("t").agg(F.count("*").alias("n_links"))
    sizes = cut(members.groupBy("component").agg(F.count("*").alias("group_size")))
    return members.join(sizes, "component").join(links, "t").select(
        "t.doc_id", "t.text_hash", F.col("component.doc_id").alias("keep_id"), F.col("component.text_hash").alias("keep_hash"), "group_size", "n_links"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Keeps the smallest text, by (doc_id, text_hash), of each group and everything in no group;
    rows that repeat both are one. Rows with a null doc_id or text stay."""
    key = unused(docs, "__hash")
    keyed = docs.withColumn(key, F.xxhash64(docs["text"].cast("string")))
    groups = near_groups(docs)
    gone = cut(groups.where("doc_id <> keep_id or text_hash <> keep_hash").select("doc_id", "text_hash"))
    there = F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    repeated = cut(keyed.where(there).groupBy(F.col("doc_id").alias("d"), F.col(key).alias("h")).agg(F.count("*").alias("n")).where("n > 1").select("d", "h"))
    left = keyed.join(gone, (keyed["doc_id"].cast("long") == gone["doc_id"]) & (keyed[key] == gone["text_hash"]) & keyed["text"].isNotNull(), "left_anti")
    if not repeated.isEmpty():
        again = (F.col("doc_id") == F.col("d")) & (F.col(key) == F.col("h")) & F.col("text").isNotNull()
        left = left.join(repeated, again, "left_anti").union(left.join(repeated, again, "left_semi").dropDuplicates(["doc_id", key]))
    return left.select(docs.columns)
