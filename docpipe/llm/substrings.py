"""Repeated passages by suffix arrays of shards.

A passage of at least MIN_WORDS words that occurs twice holds a fingerprint that occurs twice:
of every window of MIN_WORDS words the least hash of its GRAM-word sequences is a mark
(winnowing), so equal windows hold an equal mark at the same place. The surroundings of a mark
are all windows that hold it, and equal surroundings collapse before any text is shuffled: the
least (doc_id, text, position) stands for them, and each other place is a later occurrence as
a whole. What is left are marks with several different surroundings. All of those of a mark go
to one shard, named by the place where the mark occurs first, so that neighbouring marks travel
as one stretch; a text goes to as many shards as its marks name and nothing is chained further.
Each shard is sorted by the external induced sorting of `suffix.py`, and equal neighbours in
the suffix array are the repeats: the occurrence with the least (doc_id, position) stays, every
later one is reported. A mark with more than `hot` different surroundings would fill a shard by
itself; its windows, each of a text once, are grouped by their hashes instead, with partial sums
before the shuffle, so no task ever holds one mark's places. Both ways are exact and give the
same rows.

Words are runs of non-space bytes, compared as they stand (64-bit hashes of words; surroundings
and windows agree in 128 bits). Defined results: null and empty texts have no passages; rows
with null doc_id are ignored; rows that repeat a doc_id and text are one text; for one doc_id
with several texts (ordered by `text_hash`) positions refer to each text by its `text_hash`; a
passage repeated within one text counts like any other; texts may be of any length; further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut, id_column, perhaps, scratch_root, unused
from .kernel import U, Words, blocks, mix, prefix, signed, span, windows
from .suffix import Scratch, suffix_array

MIN_WORDS = 50
SHARD_WORDS, SORT_MEMORY = 500_000, 1 << 20
SPANS = "doc_id long, text_hash long, start long, stop long, n_words long, first_doc_id long"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(id_column(docs), docs["text"].cast("string").alias("text")).where(
        "doc_id is not null and text is not null"
    )


def _winnow(grams: np.ndarray, size: int) -> np.ndarray:
    """Places of the rightmost least of every `size` consecutive values."""
    n = len(grams) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, step = grams, 1
    while 2 * step <= size:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < size:
        least = np.minimum(least[: n], least[size - step : size - step + n])
    # A value stands for the windows around it whose least it is.
    near = np.empty(len(grams), bool)
    padded = np.concatenate([np.full(size - 1, least[0]), least, np.full(size - 1, least[-1])])
    top, step = padded, 1
    while 2 * step <= size:
        top = np.maximum(top[:-step], top[step:])
        step *= 2
    m = len(grams)
    top = np.maximum(top[:m], top[size - step : size - step + m]) if step < size else top[:m]
    near = grams == top
    # In windows of ties every place of the least counts: equal windows still agree.
    return np.flatnonzero(near)


def _marks(min_words: int, gram: int, full: bool):
    """Marks of texts (doc_id, text_hash, text): the marks alone, or with their places and the
    hashes of their surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, edge = min_words - gram + 1, U(0xFFFFFFFFFFFFFFFF)
        for batch in batches:
            for row, texts in blocks(batch.column(2)):
                w = Words(texts, space=True, fold=False)
                h = w.hashes()
                grams = windows(h, gram)
                if not len(grams):
                    continue
                # Sequences that run over the end of a text are no marks.
                grams[np.flatnonzero(w.doc[: len(grams)] != w.doc[gram - 1 :])] = edge
                at = _winnow(grams, size)
                at = at[grams[at] != edge]
                mark = pa.array(signed(grams[at]))
                if not full:
                    yield pa.record_batch([mark], ["mark"])
                    continue
                doc = w.doc[at]
                low, high = np.maximum(w.first[doc], at - size + 1), np.minimum(w.first[doc + 1], at + min_words)
                around = span(prefix(h), low, high) ^ mix((at - low).astype(U) + U(1))
                ids = [batch.column(k).slice(row, len(texts)).take(pa.array(doc)) for k in (0, 1)]
                yield pa.record_batch([*ids, mark, pa.array((at - w.first[doc]).astype(np.int32)), pa.array(signed(around))], ["doc_id", "text_hash", "mark", "word", "around"])

    return run


def _islands(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether each of the intervals, sorted by key and low, starts apart from those before."""
    new = np.append(True, key[1:] != key[:-1])
    if len(low) > 1:
        order = np.cumsum(new) - 1
        lift = order * (int(high.max()) + 2)
        new[1:] |= (low + lift)[1:] > np.maximum.accumulate(high + lift)[:-1]
    return new


def _cutter(min_words: int, gram: int, shards: int):
    """Texts (doc_id, text_hash, text, marks) to stretches for the shards; to the places that repeat
    the surroundings of an earlier one (shard DONE), which need no sorting; and to the windows of
    marks with very many surroundings (shard CROWDED), each window of a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = min_words - gram + 1
        for batch in batches:
            for row, texts in blocks(batch.column(2)):
                w = Words(texts, space=True, fold=False)
                lists = batch.column(3).slice(row, len(texts))
                count = lists.value_lengths().to_numpy(zero_copy_only=False)
                flat = lists.flatten()
                word, mark, around, shard, origin = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5))
                doc = np.repeat(np.arange(len(texts)), count)
                n = np.diff(w.first)[doc]
                low, high = np.maximum(0, word - size + 1), np.minimum(n, word + min_words)
                order = np.lexsort((word, shard, doc))
                word, mark, around, shard, origin, doc, low, high = (x[order] for x in (word, mark, around, shard, origin, doc, low, high))
                crowded = shard == CROWDED
                if crowded.any():
                    yield _windows(batch, row, w, min_words, doc[crowded], low[crowded], (high - min_words)[crowded], mark[crowded], around[crowded], shards)
                    word, mark, around, shard, origin, doc, low, high = (x[~crowded] for x in (word, mark, around, shard, origin, doc, low, high))
                    if not len(word):
                        continue
                new = _islands(doc * (shards + 1) + shard + 1, low, high)
                head = np.flatnonzero(new)
                island = np.cumsum(new) - 1
                stop = np.maximum.reduceat(high, head)
                first, last = w.first[doc[head]] + low[head], w.first[doc[head]] + stop - 1
                base = w.base[doc[head]]
                b0, b1 = w.start[first] - base, w.end[last] - base
                sorts = shard[head] >= 0
                # A stretch of copies is told once for each of its marks whose surroundings start it.
                begins = (shard < 0) & (low == low[head][island])
                rows = np.concatenate([np.flatnonzero(sorts), island[begins]])
                inner = np.concatenate([np.arange(len(word))[sorts[island]], np.flatnonzero(begins)])
                offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(np.append(head, len(word)))[sorts], np.ones(int(begins.sum()), np.int64)]))]).astype(np.int32)
                pieces = [texts[d][x:y] if s else None for d, x, y, s in zip(doc[head][rows].tolist(), b0[rows].tolist(), b1[rows].tolist(), sorts[rows].tolist())]
                to = np.where(sorts[rows], shard[head][rows], (doc[head][rows] + row) % shards)
                ids = [batch.column(k).take(pa.array(doc[head][rows] + row)) for k in (0, 1)]
                of = lambda x, kind: pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(kind)))
                yield pa.record_batch(
                    [
                        pa.array(to.astype(np.int32)), pa.array(np.where(sorts[rows], EXACT, COPY).astype(np.int32)), *ids, pa.array(low[head][rows].astype(np.int32)), pa.array(stop[rows].astype(np.int32)),
                        pa.array(b0[rows]), pa.array(b1[rows]), pa.array(np.where(sorts, 0, origin[head])[rows]), pa.array(pieces, pa.binary()),
                        of((word - low[head][island])[inner], np.int32), of(mark[inner], np.int64), of(around[inner], np.int64),
                        pa.array(np.diff(w.first)[doc[head][rows]].astype(np.int32)), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()),
                    ],
                    [x.split()[0] for x in PIECES.split(", ")],
                )

    return run


def _windows(batch: pa.RecordBatch, row: int, w: Words, min_words: int, doc: np.ndarray, low: np.ndarray, high: np.ndarray, mark: np.ndarray, around: np.ndarray, shards: int) -> pa.RecordBatch:
    """Rows of PIECES: the windows that start at words low to high of their texts, each once (WINDOW),
    and the first window of each mark (HEAD)."""
    h = w.hashes()
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, w.first[doc] + low, 1)
    np.add.at(edge, w.first[doc] + high + 1, -1)
    at = np.concatenate([np.flatnonzero(np.cumsum(edge)[:-1] > 0), w.first[doc] + low])
    n, own = len(at) - len(doc), w.doc[at]
    keys = [span(prefix(x), at, at + min_words) for x in (h, mix(h ^ U(0xA5A5A5A5A5A5A5A5)))]
    ids = [batch.column(k).slice(row).take(pa.array(own)) for k in (0, 1)]
    w0 = at - w.first[own]
    only = lambda x: pa.ListArray.from_arrays(pa.array(np.append(np.zeros(n, np.int32), np.arange(len(x) + 1, dtype=np.int32))), pa.array(x))
    columns = {
        "shard": (signed(keys[0]) % shards).astype(np.int32), "kind": np.repeat(np.array([WINDOW, HEAD], np.int32), [n, len(doc)]), "w0": w0.astype(np.int32), "w1": (w0 + min_words).astype(np.int32),
        "b0": w.start[at] - w.base[own], "b1": w.end[at + min_words - 1] - w.base[own], "k1": signed(keys[0]), "k2": signed(keys[1]),
    }
    nothing = {"origin": pa.int64(), "text": pa.binary(), "at": pa.list_(pa.int32()), "n": pa.int32()}
    names = [x.split()[0] for x in PIECES.split(", ")]
    given = {"doc_id": ids[0], "text_hash": ids[1], "marks": only(mark), "arounds": only(around)}
    return pa.record_batch([given[c] if c in given else pa.array(columns[c]) if c in columns else pa.nulls(len(at), nothing[c]) for c in names], names)


PIECES = "shard int, kind int, doc_id long, text_hash long, w0 int, w1 int, b0 long, b1 long, origin long, text binary, at array<int>, marks array<long>, arounds array<long>, n int, k1 long, k2 long"
RUNS = "kind int, doc_id long, text_hash long, w0 int, w1 int, b0 long, b1 long, origin long, mark long, around long, k1 long, k2 long"
# A run (or stretch to sort); a run whose origin may be earlier; where surroundings begin first; a
# window to be grouped; the first window of a crowded mark's surroundings.
EXACT, COPY, ORIGIN, WINDOW, HEAD = range(5)
DONE, CROWDED = -1, -2


def _runs(kind: int, n: int, **columns: np.ndarray) -> pa.RecordBatch:
    names = [x.split() for x in RUNS.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64()}
    return pa.record_batch(
        [pa.array(np.full(n, kind, np.int32)) if c == "kind" else pa.array(columns[c]).cast(kinds[t]) if c in columns else pa.nulls(n, kinds[t]) for c, t in names],
        [c for c, _ in names],
    )


class Shard:
    """Stretches of text on disk, sorted into later occurrences. In memory are only the distinct
    words and one batch at a time."""

    def __init__(self, scratch: Scratch, min_words: int, gram: int):
        self.scratch, self.min_words, self.size = scratch, min_words, min_words - gram + 1
        self.files = {k: open(scratch.file(), "w+b") for k in ("hashes", "places", "stretches", "marks")}
        self.n, self.vocabulary = 0, np.zeros(0, np.uint64)

    def add(self, part: pa.RecordBatch, texts: list[bytes]) -> None:
        w = Words(texts, space=True, fold=False)
        h = w.hashes()
        self.files["hashes"].write(h)
        self.vocabulary = np.union1d(self.vocabulary, h)
        doc, text_hash, w0, b0, total = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3, 4, 6, 13))
        offset = b0[w.doc] - w.base[w.doc]
        self.files["places"].write(np.stack([w.start + offset, w.end + offset], 1).astype(np.int64))
        first = w.first[:-1] + self.n
        self.files["stretches"].write(np.stack([first, doc, text_hash, w0], 1))
        count = part.column(10).value_lengths().to_numpy(zero_copy_only=False)
        own = np.repeat(np.arange(len(texts)), count)
        at, mark, around = (part.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (10, 11, 12))
        # The windows that hold the mark, within the stretch and its text.
        low = np.maximum(0, at - self.size + 1)
        high = np.minimum(at, np.minimum(np.diff(w.first)[own], (total - w0)[own]) - self.min_words)
        keep = high >= low
        self.files["marks"].write(np.stack([first[own] + low, high - low + 1, mark, around], 1)[keep])
        self.n += len(h)

    def _table(self, name: str, kind: type, width: int) -> np.ndarray:
        file = self.files[name]
        file.flush()
        n = os.path.getsize(file.name) // (np.dtype(kind).itemsize * width)
        return np.memmap(file.name, kind, "r", shape=(n, width)) if n else np.zeros((0, width), kind)

    def runs(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        scratch, n, min_words = self.scratch, self.n, self.min_words
        hashes = self._table("hashes", np.uint64, 1)[:, 0]
        digits = int(np.sqrt(len(self.vocabulary))) + 1
        small = scratch.array(2 * n + 1, np.int32)
        for row in range(0, n, scratch.memory):
            word = np.searchsorted(self.vocabulary, hashes[row : row + scratch.memory])
            small[2 * row : 2 * (row + len(word)) : 2] = word // digits + 1
            small[2 * row + 1 : 2 * (row + len(word)) : 2] = word % digits + 1
        small[2 * n] = 0
        del hashes
        self.files["hashes"].close()
        os.unlink(self.files["hashes"].name)
        sa, lcp = suffix_array(small, digits + 2, 2 * min_words + 2, scratch)
        scratch.drop(small)
        del small
        places, stretches, marks = self._table("places", np.int64, 2), self._table("stretches", np.int64, 4), self._table("marks", np.int64, 4)
        first = np.append(stretches[:, 0], n)
        source = scratch.array(n, np.int32 if n < (1 << 31) - 1 else np.int64)  # of each word that starts a later occurrence: the first one, plus one
        step = max(1024, 2 * scratch.memory)
        row = 0
        while row < len(sa):
            stop = min(len(sa), row + step)
            while stop < len(sa) and lcp[stop] >= 2 * min_words:  # a group stays in one piece
                stop += 1
            at, common = np.asarray(sa[row:stop]).astype(np.int64), np.array(lcp[row:stop])
            keep = np.flatnonzero((at % 2 == 0) & (at < 2 * n))
            if len(keep):
                new = np.cumsum(common < 2 * min_words)[keep]
                at = at[keep] // 2
                whole = first[np.searchsorted(first, at, "right")] - at >= min_words
                at, new = at[whole], new[whole]
                if len(at):
                    head = np.flatnonzero(np.append(True, new[1:] != new[:-1]))
                    least = np.minimum.reduceat(at, head)
                    least = np.repeat(least, np.diff(np.append(head, len(at))))
                    later = at > least
                    source[at[later]] = least[later] + 1
            row = stop
        scratch.drop(sa)
        scratch.drop(lcp)
        del sa, lcp
        region = lambda at: np.searchsorted(first, at, "right") - 1
        covered = scratch.array(n, np.int8)
        for row in range(0, len(marks), step // 32 + 1):
            low, count, mark, around = np.asarray(marks[row : row + step // 32 + 1]).T
            covered[np.repeat(low - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())] = 1
            begin = np.asarray(source[low]).astype(np.int64)
            some = np.flatnonzero(begin > 0)
            if len(some):
                yield _runs(ORIGIN, len(some), mark=mark[some], around=around[some], origin=stretches[region(begin[some] - 1), 1])
        for row in range(0, n, step):
            at = np.flatnonzero(np.asarray(source[row : row + step]).astype(bool) & np.asarray(covered[row : row + step]).astype(bool)) + row
            if not len(at):
                continue
            own = region(at)
            origin = stretches[region(np.asarray(source[at]).astype(np.int64) - 1), 1]
            head = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1]) | (origin[1:] != origin[:-1])))
            low, high, own = at[head], at[np.append(head[1:], len(at)) - 1] + min_words, own[head]
            shift = stretches[own, 3] - first[own]
            yield _runs(EXACT, len(head), doc_id=stretches[own, 1], text_hash=stretches[own, 2], w0=low + shift, w1=high + shift, b0=places[low, 0], b1=places[high - 1, 1], origin=origin[head])


def _sorter(root: str | None, min_words: int, gram: int, memory: int):
    """Stretches, sorted by shard and place, to the runs of each shard; copies pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = root or next((os.environ[k].split(",")[0] for k in ("LOCAL_DIRS", "SPARK_LOCAL_DIRS") if k in os.environ), None)
        scratch, shard, at, last = None, None, None, None
        try:
            for batch in batches:
                rest = batch.filter(pc.is_null(batch.column(9)))
                if len(rest):
                    first = lambda k: pa.array([x[0] if x else None for x in rest.column(k).to_pylist()], pa.int64())
                    yield pa.record_batch([*(rest.column(k) for k in range(1, 9)), first(11), first(12), rest.column(14), rest.column(15)], [x.split()[0] for x in RUNS.split(", ")])
                batch = batch.filter(pc.is_valid(batch.column(9)))
                key = list(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))))
                fresh = [k != (key[i - 1] if i else last) for i, k in enumerate(key)]  # a row that repeats one is the same text
                last = key[-1] if key else last
                batch = batch.filter(pa.array(fresh, pa.bool_()))
                number = batch.column(0).to_numpy(zero_copy_only=False)
                edges = np.flatnonzero(np.append(True, number[1:] != number[:-1])).tolist() if len(number) else []
                for low, high in zip(edges, [*edges[1:], len(number)]):
                    if number[low] != at:
                        if shard is not None:
                            yield from shard.runs()
                            scratch.close()
                        scratch, at = Scratch(own, memory), number[low]
                        shard = Shard(scratch, min_words, gram)
                    part = batch.slice(low, high - low)
                    for row, texts in blocks(part.column(9)):
                        shard.add(part.slice(row, len(texts)), texts)
            if shard is not None:
                yield from shard.runs()
        finally:
            if scratch is not None:
                scratch.close()

    return run


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, gram: int | None = None, shard_words: int = SHARD_WORDS, memory: int = SORT_MEMORY, hot: int | None = None) -> DataFrame:
    """SPANS: the later occurrences of repeated passages, as bytes start to stop of the text,
    joined where they touch, with the document in which the first MIN_WORDS words of the span
    occur first."""
    spark = docs.sparkSession
    gram = gram or max(1, min_words // 2)
    # The surroundings of one mark, some 1.5 * min_words words each, take a small part of a shard.
    hot = hot or max(1, shard_words // 1000)
    texts = _texts(docs).withColumn("text_hash", F.xxhash64("text")).select("doc_id", "text_hash", "text")
    own = ("doc_id", "text_hash")
    place = F.struct(*own, "word")
    twice = cut(texts.mapInArrow(_marks(min_words, gram, False), "mark long").groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"))
    marks = texts.mapInArrow(_marks(min_words, gram, True), "doc_id long, text_hash long, mark long, word int, around long")
    # An inner join: a semi-join would be moved below the filter before it.
    marks = cut(perhaps(marks, twice, "mark").join(twice, "mark"))
    # Equal surroundings of a mark are one; the first of them stands for all.
    around = cut(marks.groupBy("mark", "around").agg(F.min(place).alias("rep"), F.count("*").alias("n")))
    of_mark = around.groupBy("mark").agg(F.min("rep").alias("lead"), F.count("*").alias("n_around"), F.sum("n").alias("total")).where("total > 1")
    lead = F.xxhash64("lead.doc_id", "lead.text_hash", F.floor(F.col("lead.word") / 512))
    of_mark = cut(of_mark.select("mark", "n_around", lead.alias("lead")))
    total, n_hot = of_mark.agg(F.sum(F.when((F.col("n_around") > 1) & (F.col("n_around") <= hot), F.col("n_around"))), F.max(F.col("n_around") > hot)).first()
    # A mark stands for about (min_words - gram + 2) / 2 words, and stretches have two ends.
    shards = max(1, -(-(total or 0) * (min_words - gram + 2) // shard_words))
    to = F.when(F.col("n_around") > hot, CROWDED).otherwise(F.pmod("lead", F.lit(shards))).cast("int")
    around = cut(around.join(of_mark, "mark").where("n > 1 or n_around > 1").select("mark", "around", "rep", F.when(F.col("n_around") > 1, to).alias("to")))
    placed = marks.join(around, ["mark", "around"]).withColumn("shard", F.when(F.col("rep") != place, DONE).otherwise(F.col("to"))).where("shard is not null")
    # Rows that repeat a doc_id and text have equal lists, one of which is enough.
    lists = cut(placed.groupBy(*own).agg(F.collect_set(F.struct("word", "mark", "around", "shard", F.col("rep.doc_id").alias("origin"))).alias("m")))
    found = cut(
        perhaps(texts, lists, *own).join(lists, [*own]).select(*own, "text", "m")
        .mapInArrow(_cutter(min_words, gram, shards), PIECES)
        .repartitionById(shards, "shard").sortWithinPartitions("shard", *own, "w0")
        .mapInArrow(_sorter(scratch_root(spark), min_words, gram, memory), RUNS)
    )
    origins = found.where(F.col("kind") == ORIGIN).select("mark", "around", F.col("origin").alias("earlier"))
    runs = found.where(F.col("kind") == EXACT).select(*own, "w0", "w1", "b0", "b1", "origin")
    if n_hot:
        at = F.struct(*own, "w0")
        windows_of = found.where(F.col("kind") == WINDOW)
        first = cut(windows_of.groupBy("k1", "k2").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").select("k1", "k2", "first"))
        later = found.where(F.col("kind").isin(WINDOW, HEAD)).join(first, ["k1", "k2"]).where(at != F.col("first"))
        runs = runs.union(later.where(F.col("kind") == WINDOW).select(*own, "w0", "w1", "b0", "b1", F.col("first.doc_id")))
        origins = origins.union(later.where(F.col("kind") == HEAD).select("mark", "around", F.col("first.doc_id")))
    copies = found.where(F.col("kind") == COPY).join(origins, ["mark", "around"], "left")
    runs = runs.union(copies.select(*own, "w0", "w1", "b0", "b1", F.coalesce("earlier", "origin")))
    before = W.partitionBy(*own).orderBy("w0", "w1").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*own).orderBy("w0", "w1").rowsBetween(W.unboundedPreceding, 0)
    apart = F.coalesce(F.col("w0") > F.max("w1").over(before), F.lit(True))
    return (
        runs.distinct().withColumn("apart", apart).withColumn("span", F.sum(F.col("apart").cast("long")).over(upto))
        .groupBy(*own, "span").agg(
            F.min("b0").alias("start"), F.max("b1").alias("stop"), (F.max("w1") - F.min("w0")).cast("long").alias("n_words"), F.min(F.struct("w0", "origin"))["origin"].alias("first_doc_id"),
        ).drop("span")
    )


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without the later occurrences of repeated passages. A document of which
    no word is left goes, since all of it stands elsewhere; documents that had none stay, and
    so do rows with a null doc_id. n_chars, where there is one, follows the new text."""
    own, key = unused(docs, "__spans"), unused(docs, "__hash")
    spans = cut(repeated_spans(docs, min_words).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(own)))
    keyed = docs.withColumn(key, F.xxhash64(docs["text"].cast("string")))
    changed = keyed.join(spans, (keyed["doc_id"].cast("long") == spans["doc_id"]) & (keyed[key] == spans["text_hash"]), "left").select(
        *(keyed[c] for c in docs.columns), spans[own]
    )
    untouched = F.col(own).isNull()
    new = _cut_text(F.col("text"), F.col(own))
    result = changed.withColumn("text", F.when(untouched, F.col("text")).otherwise(new))
    result = result.where(untouched | (F.trim(F.regexp_replace("text", r"[\s]+", " ")) != ""))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        result = result.withColumn("n_chars", F.when(untouched, F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return result.select(docs.columns)


def _cut_text(text: Column, spans: Column) -> Column:
    """Bytes outside the spans, which are sorted and may overlap, within the JVM."""
    raw = F.encode(text.cast("string"), "UTF-8")
    start = F.aggregate(
        spans,
        F.struct(F.lit(1).cast("long").alias("at"), F.lit("").alias("kept")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["stop"] + 1).alias("at"),
            F.concat(acc["kept"], F.decode(F.substring(raw, acc["at"].cast("int"), F.greatest(F.lit(0), s["start"] + 1 - acc["at"]).cast("int")), "UTF-8")).alias("kept"),
        ),
    )
    return F.concat(start["kept"], F.decode(F.substring(raw, start["at"].cast("int"), F.octet_length(text)), "UTF-8"))
