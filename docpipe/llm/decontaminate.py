"""Benchmark decontamination by spaced seeds.

A mask keeps some of the tokens of a window; windows that agree on the kept ones have equal
hashes, whatever stands at the others. Every window of every document is looked up, for every
mask, in the hashes of the benchmark. A hit puts a benchmark item at an offset in a document.

PAIRS keep two tokens. Of an item's n tokens let m be equal at an offset. At most (n - m) / 2 of
the m - 1 steps from one of them to the next are longer than 2, so at least m - 1 - (n - m) / 2
pairs hit there: with m = RATIO * n, one at least from LEAST tokens on, wherever the others stand,
so no item is missed. Offsets with under a third of those hits (parts of an item between
insertions have fewer than the whole) and, once the item is laid over the document there, those
with fewer than PART equal tokens are left out. MASKS keep 9 of 12 tokens: an offset that they
hit always counts.

Equal tokens of offsets that differ by at most SHIFT, and of those that MASKS hit, add up by item
position, so substitutions, insertions and deletions are tolerated. A document leaks an item if at
least RATIO of the item's tokens are found.

The benchmark's hashes go to the executors in slices of at most SLICE of them, one pass over
the documents for each slice, so what is broadcast doesn't grow with the benchmark.

Items of fewer than LEAST tokens are seeded by all their tokens, contiguously. Defined results: null
or wordless items and documents leak nothing; null ids are ignored; equal items are reported
each under its own item_id; rows that repeat a doc_id are looked at one by one and the best
of each pair is reported; of offsets that match equally the first counts; texts and items of any
length, periodic ones too, are compared whole in bounded blocks; further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_column
from .kernel import HashTable, U, Words, blocks, mix, powers

MASKS = ("110110101111", "101110011111", "111011101011", "111101011011")
PAIRS = ("11", "101")
LEAST, RATIO, PART, SHIFT, SLICE = 8, 0.5, 4, 8, 1 << 21
SCHEMA = "doc_id long, item_id long, matched int, item_tokens int, ratio double, start int, stop int"


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash of every window."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U)
    coefficient = powers(64)[0]
    total = np.zeros(n, U)
    for k, kept in enumerate(mask):
        if kept == "1":
            total += hashes[k : k + n] * coefficient[k + 1]
    # A different constant for each mask: masks never meet each other's hashes.
    return mix(total ^ U(int("1" + mask, 2) * BASE_STEP & (1 << 64) - 1))


BASE_STEP = 0xC2B2AE3D27D4EB4F


class Index:
    """Spaced hashes of some benchmark items, ready for lookup."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = [t.encode("utf-8", "replace") for _, t in items]
        w = Words(texts)
        self.hashes, self.first = w.hashes(), w.first
        self.ids = np.array([i for i, _ in items], np.int64)
        count = np.diff(w.first)
        self.masks = [*PAIRS, *MASKS, *("1" * n for n in sorted({int(c) for c in count if 0 < c < LEAST}))]
        keys, item, offset = [], [], []
        for k, mask in enumerate(self.masks):
            h = seeds(self.hashes, mask)
            if not len(h):
                continue
            owner = w.doc[: len(h)]
            inside = owner == w.doc[len(mask) - 1 :]
            whole = k >= len(PAIRS) + len(MASKS)
            inside &= count[owner] == len(mask) if whole else count[owner] >= LEAST
            keys.append(h[inside])
            item.append(owner[inside])
            offset.append(np.flatnonzero(inside) - w.first[owner[inside]])
        keys = np.concatenate(keys) if keys else np.zeros(0, U)
        item = np.concatenate(item) if item else np.zeros(0, np.int64)
        offset = np.concatenate(offset) if offset else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.item, self.offset = item[order], offset[order]
        unique, self.begin = np.unique(keys[order], return_index=True)
        self.begin = np.append(self.begin, len(keys))
        self.table = HashTable(unique)
        self.bits = 22
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[(unique >> U(64 - self.bits)).astype(np.int64)] = True

    def search(self, words: Words, ratio: float = RATIO) -> list[tuple]:
        """(text, item, matched, tokens, start, stop), start and stop in words of the text, of
        the items of which at least `ratio` is found."""
        h = words.hashes()
        # One number for an item in a text at a diagonal, which may begin before the text.
        count, length = np.diff(self.first), np.diff(words.first)
        front = int(count.max(initial=0))
        wide = front + int(length.max(initial=0)) + 1
        light: list[tuple[np.ndarray, np.ndarray]] = []
        heavy: list[np.ndarray] = [np.zeros(0, np.int64)]
        for k, mask in enumerate(self.masks):
            s = seeds(h, mask)
            at = np.flatnonzero(self.maybe[(s >> U(64 - self.bits)).astype(np.int64)])
            if not len(at):
                continue
            place = self.table.find(s[at])
            at, place = at[place >= 0], place[place >= 0]
            inside = words.doc[at] == words.doc[at + len(mask) - 1]
            at, place = at[inside], place[inside]
            many = self.begin[place + 1] - self.begin[place]
            for part in _bounded(many):
                entry = np.repeat(self.begin[place[part]], many[part]) + _within(many[part])
                here = np.repeat(at[part], many[part])
                text = words.doc[here]
                diagonal = here - self.offset[entry] - words.first[text] + front
                key, n = np.unique((text * len(count) + self.item[entry]) * wide + diagonal, return_counts=True)
                if k < len(PAIRS):
                    light.append((key, n))
                else:
                    heavy.append(key)
        sure = np.unique(np.concatenate(heavy))
        hits, place = np.unique(np.concatenate([np.zeros(0, np.int64), *(x for x, _ in light)]), return_inverse=True)
        n_hits = np.bincount(place, np.concatenate([np.zeros(0), *(n for _, n in light)]), len(hits))
        size = count[hits // wide % max(1, len(count))]
        equal = np.ceil(ratio * size)
        hits = np.union1d(sure, hits[3 * n_hits >= equal - 1 - (size - equal) / 2])
        if not len(hits):
            return []
        owner, diagonal = np.divmod(hits, wide)
        text, item = np.divmod(owner, len(count))
        diagonal += words.first[text] - front
        size = count[item]

        def cells(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Equal tokens of some hits laid over their texts: hit, item position, text position."""
            hit, k = np.repeat(rows, size[rows]), _within(size[rows])
            there = diagonal[hit] + k
            inside = (there >= words.first[text[hit]]) & (there < words.first[text[hit] + 1])
            hit, k, there = hit[inside], k[inside], there[inside]
            same = h[there] == self.hashes[self.first[item[hit]] + k]
            return hit[same], k[same], there[same]

        n_equal = np.zeros(len(hits), np.int64)
        for part in _bounded(size):
            n_equal += np.bincount(cells(np.arange(part.start, part.stop))[0], minlength=len(hits))
        always = np.isin(hits, sure, assume_unique=True)
        good = always | (n_equal >= PART)
        # What the offsets of an item in a text have together, at most.
        begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        ends = np.append(begins[1:], len(hits))
        most = np.add.reduceat(n_equal * good, begins)
        out = []
        for low, high in zip(begins[most >= ratio * size[begins]].tolist(), ends[most >= ratio * size[begins]].tolist()):
            same = np.flatnonzero(good[low:high]) + low
            tokens = int(size[low])
            fixed = np.zeros(tokens, bool)  # positions found at offsets that always count
            for part in _bounded(size[same[always[same]]]):
                fixed[cells(same[always[same]][part])[1]] = True
            # An equal token at a diagonal counts for the diagonals up to SHIFT before it: a sum of
            # intervals, which are cut where the same item position had one before.
            base = int(diagonal[low])
            change = np.zeros(int(diagonal[high - 1]) - base + 2, np.int64)
            before = np.full(tokens, -1)
            for part in _bounded(size[same]):
                hit, k, _ = cells(same[part])
                z = diagonal[hit] - base
                keep = ~fixed[k]
                order = np.lexsort((z[keep], k[keep]))
                k, z = k[keep][order], z[keep][order]
                if not len(k):
                    continue
                new = np.append(True, k[1:] != k[:-1])
                last = np.where(new, before[k], np.append(-1, z[:-1]))
                np.add.at(change, np.maximum(np.maximum(z - SHIFT, 0), last + 1), 1)
                np.add.at(change, z + 1, -1)
                tail = np.append(new[1:], True)
                before[k[tail]] = z[tail]
            matched = np.cumsum(change)[diagonal[same] - base] + int(fixed.sum())
            best = int(matched.argmax())
            if matched[best] < ratio * tokens:
                continue
            reach = diagonal[same] - diagonal[same[best]]
            spots = same[always[same] | (reach >= 0) & (reach <= SHIFT)]
            start, stop = np.iinfo(np.int64).max, 0
            for part in _bounded(size[spots]):
                there = cells(spots[part])[2]
                start, stop = min(start, int(there.min(initial=start))), max(stop, int(there.max(initial=0)) + 1)
            shift = int(words.first[text[low]])
            out.append((int(text[low]), int(item[low]), int(matched[best]), tokens, start - shift, stop - shift))
        return out


def _bounded(sizes: np.ndarray, limit: int = 1 << 21) -> Iterator[slice]:
    """Slices whose sizes add up to about the limit at most."""
    upto = np.cumsum(sizes)
    row = 0
    while row < len(sizes):
        stop = max(row + 1, int(np.searchsorted(upto, (upto[row - 1] if row else 0) + limit, "right")))
        yield slice(row, stop)
        row = stop


def _within(sizes: np.ndarray) -> np.ndarray:
    """0 .. size-1 for each of the sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


_indexes: dict[str, Index] = {}


def _finder(name: str, items: Callable[[], list[tuple[int, str]]], ratio: float):
    """name: a worker keeps the index from task to task by it."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _indexes:
            _indexes.clear()
            _indexes[name] = Index(items())
        ix = _indexes[name]
        for batch in batches:
            ids = batch.column(0)
            for row, texts in blocks(batch.column(1)):
                rows = ix.search(Words(texts), ratio)
                if not rows:
                    continue
                x, y, matched, tokens, start, stop = map(np.array, zip(*rows))
                yield pa.record_batch(
                    [
                        ids.slice(row, len(texts)).take(pa.array(x)), pa.array(ix.ids[y]),
                        pa.array(matched, pa.int32()), pa.array(tokens, pa.int32()),
                        pa.array(matched / tokens), pa.array(start, pa.int32()), pa.array(stop, pa.int32()),
                    ],
                    [c.split()[0] for c in SCHEMA.split(", ")],
                )

    return find


def leaks(docs: DataFrame, benchmark: DataFrame, ratio: float = RATIO, slice_hashes: int = SLICE) -> DataFrame:
    """SCHEMA for every document and item that it leaks; start and stop are words."""
    spark = docs.sparkSession
    texts = docs.select(id_column(docs), docs["text"].cast("string").alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select(id_column(benchmark, "item_id"), benchmark["text"].cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    results: list[DataFrame] = []

    def passed(part: list[tuple[int, str]]) -> None:
        shipped = spark.sparkContext.broadcast(part)
        results.append(texts.mapInArrow(_finder(uuid.uuid4().hex, lambda: shipped.value, ratio), SCHEMA))

    part, hashes = [], 0
    # A benchmark is read by slices on the driver: only one slice is held at a time.
    for row in items.orderBy("item_id", "text").toLocalIterator():
        part.append((row["item_id"], row["text"]))
        hashes += len(PAIRS + MASKS) * (len(row["text"]) // 2 + 1)
        if hashes >= slice_hashes:
            passed(part)
            part, hashes = [], 0
    if part or not results:
        passed(part)
    found = results[0]
    for more in results[1:]:
        found = found.union(more)
    best = F.max_by(F.struct("matched", "item_tokens", "ratio", "start", "stop"), F.struct("matched", -F.col("start"))).alias("r")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "r.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Drops the documents that leak an item; rows with a null doc_id or text stay."""
    found = leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
