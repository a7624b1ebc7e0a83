"""Toxic documents by class-conditional Kneser-Ney models.

A word is a sequence of bytes between two marks, and its bytes are predicted one by one from up
to ORDER - 1 bytes before them in the word; such a sequence is packed into one integer exactly,
without hashing. The highest order has counts of its own for toxic and for ordinary labelled
documents. What they back off to is shared: the same order counted over every document,
labelled or not, and below it Kneser-Ney continuation counts (in how many different contexts
a byte occurs) over every document.

  p_c(w | h) = max(n_c(hw) - D, 0) / (n_c(h) + SHARED) + gamma_c(h) p(w | h)
  gamma_c(h) = (D * (different w seen after h in class c) + SHARED) / (n_c(h) + SHARED)

with p shared by both classes. SHARED counts are added to each class in the proportions of p:
what a class has seen a few times, or happens not to have seen, is no evidence, and a sequence
that both classes see rarely has the same probability in both. Toxic documents are mostly
ordinary text, so a few words decide: a document's score
is that of its most toxic passage, the difference of the two log-likelihoods of PASSAGE
consecutive words over their number (a shorter text is one passage). The same difference over the
whole document and all its words is reported as document_score; it doesn't decide, since a toxic
expression in a text of thousands of ordinary words leaves next to nothing of it.

The classes are counted over all labelled documents, whatever their number. No text is shuffled:
ids and classes go to every task as sorted arrays, in slices of about LABEL_SLICE labels, and each
slice after the first is one more pass over its own documents. The shared counts are those of all
documents. Sequences seen in either class have their log ratio in a table; for others p cancels and
the ratio depends on the context h alone, which has a table too. Both tables are computed by
DataFrame joins. Log ratios are whole multiples of 1 / STEPS nats (a part of the model, at any
size), and a sequence isn't kept whose ratio is that of its context, nor a context with ratio 0,
as both then say what is said without them. Scoring ships the tables if they have at most SHIP
rows, else the corpus's different words join them; sums of whole numbers are exact, so both ways
give the same scores.

There are two models, each of one half of the labelled documents; both come from one pass,
which counts by halves. A document's score is the mean of theirs, so that an expression counts
in full only if both halves have it: what stands in one toxic document alone doesn't. The
threshold is the one that separates the labelled documents best, by F1, when each is scored by
the model of the half that it doesn't belong to.

Defined results: null and wordless texts have no score and are never toxic; rows with null
doc_id, and labels that are null or contradict each other, are ignored in training, and null
doc_ids are not reported; rows that repeat a doc_id are scored one by one and the highest
score counts; if one class has no labelled document nothing is reported; further columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut, id_column
from .kernel import HashTable, U, Words, blocks

ORDER, DISCOUNT, SHARED, PASSAGE, SHIP = 7, 0.75, 20.0, 2, 1 << 22
LABEL_SLICE, STEPS = 1 << 23, 64
COUNTS = ("t0", "o0", "t1", "o1", "n")
EDGE = 0x20  # stands before and behind each word


def sequences(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequence that ends in each byte of each word and in its closing mark, zeros in front
    where the word has fewer bytes before; the word of each sequence; the text of each word."""
    w = Words([b" " + t for t in texts])
    data = w.data.copy()
    data[w.start - 1] = EDGE
    data[w.end] = EDGE
    size = w.end - w.start + 1
    word = np.repeat(np.arange(len(size)), size)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(w.start, size) + within
    keys = np.zeros(len(at), U)
    for back in range(order - 1, -1, -1):
        keys <<= U(8)
        keys |= np.where(within + 1 >= back, data[at - np.minimum(back, within + 1)], 0).astype(U)
    return keys, word, w.doc


def _class_of(column: pa.Array, ids: np.ndarray, klass: np.ndarray) -> np.ndarray:
    """The class of each id of the column by the sorted ids, -1 without one."""
    out = np.full(len(column), -1, np.int64)
    if len(ids):
        own = column.fill_null(0).to_numpy(zero_copy_only=False)
        place = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        hit = (ids[place] == own) & column.is_valid().to_numpy(zero_copy_only=False)
        out[hit] = klass[place[hit]]
    return out


def _count(order: int, shipped: Broadcast, every: bool):
    """Per task: every different sequence with its counts by half and class. Only the documents
    of the shipped classes are read, and not counted in n, unless `every` says all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, U), np.zeros((0, 5), np.int64))]
        waiting = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([k for k, _ in held])
            counts = np.concatenate([c for _, c in held])
            order_of = np.argsort(keys, kind="stable")
            keys, counts = keys[order_of], counts[order_of]
            head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
            return keys[head], (np.add.reduceat(counts, head) if len(head) else counts)

        for batch in batches:
            klass = _class_of(batch.column(0), *shipped.value)
            column = batch.column(1)
            if not every:
                column, klass = column.filter(pa.array(klass >= 0)), klass[klass >= 0]
            for row, texts in blocks(column):
                keys, word, doc = sequences(texts, order)
                own = klass[row : row + len(texts)][doc[word]]
                part = []
                for c in range(-1, 4):
                    sort = np.sort(keys[own == c])
                    head = np.flatnonzero(np.append(True, sort[1:] != sort[:-1])) if len(sort) else np.zeros(0, int)
                    counts = np.zeros((len(head), 5), np.int64)
                    counts[:, 4] = np.diff(np.append(head, len(sort)))
                    if c >= 0:
                        counts[:, c] = counts[:, 4]
                    if not every:
                        counts[:, 4] = 0
                    part.append((sort[head], counts))
                held += part
                waiting += sum(len(k) for k, _ in part)
                if waiting > 2_000_000:
                    held = [merged()]
                    waiting = len(held[0][0]) // 2
        keys, counts = merged()
        for row in range(0, len(keys), 100_000):
            s = slice(row, row + 100_000)
            yield pa.record_batch([pa.array(keys[s].view(np.int64)), *(pa.array(counts[s, c]) for c in range(5))], ["g", *COUNTS])

    return run


def _half(doc_id: str | Column) -> Column:
    return F.xxhash64(doc_id).bitwiseAND(F.lit(1)).cast("int")


def count(docs: DataFrame, labels: DataFrame, order: int = ORDER, label_slice: int = LABEL_SLICE) -> DataFrame:
    """(g, and COUNTS: toxic and ordinary in each half, and all) for every sequence of the corpus."""
    known = cut(
        labels.select(id_column(labels), labels["toxic"].cast("int").alias("toxic"))
        .where("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
        .where("toxic = most").select("doc_id", (2 * _half("doc_id") + 1 - F.col("toxic")).cast("int").alias("class"))
    )
    slices = max(1, -(-known.count() // label_slice))
    texts = docs.select(id_column(docs), docs["text"].cast("string").alias("text")).where("text is not null")
    counted: DataFrame | None = None
    for k in range(slices):
        part = known.where(F.pmod(F.xxhash64(F.lit("slice"), "doc_id"), F.lit(slices)) == k).toArrow()
        ids, klass = part["doc_id"].to_numpy(), part["class"].to_numpy().astype(np.int8)
        sort = np.argsort(ids)
        shipped = docs.sparkSession.sparkContext.broadcast((ids[sort], klass[sort]))
        one = texts.mapInArrow(_count(order, shipped, k == 0), ", ".join(["g long", *(f"{c} long" for c in COUNTS)]))
        counted = one if counted is None else counted.union(one)
    return counted.groupBy("g").agg(*(F.sum(c).alias(c) for c in COUNTS))


def shared_probability(grams: DataFrame, order: int, discount: float = DISCOUNT) -> DataFrame:
    """(s, p): continuation probability of every sequence of order-1 bytes of the corpus."""
    suffix = lambda g, k: g.bitwiseAND(F.lit((1 << 8 * k) - 1))
    below = None
    # Level k: in how many contexts each sequence of k bytes occurs, from sequences of k+1.
    level = {order: grams.select("g")}
    for k in range(order - 1, 0, -1):
        level[k] = level[k + 1].select(suffix(F.col("g"), k).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    for k in range(1, order):
        own = level[k].withColumn("h", F.shiftright("g", 8))
        context = W.partitionBy("h")
        own = own.withColumn("total", F.sum("n").over(context)).withColumn("kinds", F.count("*").over(context))
        first = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total")
        weight = discount * F.col("kinds") / F.col("total")
        if below is None:
            below = own.select("g", (first + weight / 256).alias("p"))
        else:
            below = (
                own.select("g", first.alias("first"), weight.alias("weight"), suffix(F.col("g"), k - 1).alias("s"))
                .join(below.select(F.col("g").alias("s"), "p"), "s")
                .select("g", (F.col("first") + F.col("weight") * F.col("p")).alias("p"))
            )
    return below.select(F.col("g").alias("s"), "p")


def ratios(grams: DataFrame, order: int = ORDER, discount: float = DISCOUNT, shared: float = SHARED) -> DataFrame:
    """(kind, key, r0, r1): kind 1 has the log ratio of a sequence, kind 0 that of the
    backoff weights of a context, in steps of 1 / STEPS; r0 and r1 are those of the models without
    half 0 and without half 1."""
    context = W.partitionBy("h")
    every = grams.withColumn("h", F.shiftright("g", 8))
    every = every.withColumn("nall", F.sum("n").over(context)).withColumn("nkinds", F.count("*").over(context))
    seen = every.where(" + ".join(COUNTS[:4]) + " > 0")
    parts = {"r0": ("t1", "o1"), "r1": ("t0", "o0")}
    own, sums = {}, {}
    for r, both in parts.items():
        for c, n in zip("to", both):
            own[f"{r}{c}n"] = F.expr(n)
            sums[f"{r}{c}all"] = F.sum(F.expr(n)).over(context)
            sums[f"{r}{c}kinds"] = F.sum(F.when(F.expr(n) > 0, 1).otherwise(0)).over(context)
    seen = seen.withColumns(own | sums)
    gamma = {
        f"{r}{c}g": (discount * F.col(f"{r}{c}kinds") + shared) / (F.col(f"{r}{c}all") + shared)
        for r in parts for c in "to"
    }
    seen = seen.withColumns(gamma).withColumn("s", F.col("g").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1)))

    def p(rc: str) -> Column:
        top = F.greatest(F.col(f"{rc}n") - discount, F.lit(0.0)) / (F.col(f"{rc}all") + shared)
        return top + F.col(f"{rc}g") * F.col("p")

    step = lambda x: F.round(F.log(x) * STEPS).cast("int")
    own_context = {f"{r}c": step(F.col(f"{r}tg") / F.col(f"{r}og")) for r in parts}
    every_p = (F.greatest(F.col("n") - discount, F.lit(0.0)) + discount * F.col("nkinds") * F.col("p")) / F.col("nall")
    top = seen.join(shared_probability(grams, order, discount), "s").withColumn("p", every_p).select(
        F.lit(1).alias("kind"), F.col("g").alias("key"), *(step(p(f"{r}t") / p(f"{r}o")).alias(r) for r in parts), *(v.alias(k) for k, v in own_context.items())
    ).where("r0 <> r0c or r1 <> r1c").select("kind", "key", *parts)
    contexts = seen.groupBy("h").agg(*(F.first(own_context[f"{r}c"]).alias(r) for r in parts)).where("r0 <> 0 or r1 <> 0")
    return top.union(contexts.select(F.lit(0), F.col("h"), *parts))


class Tables:
    def __init__(self, kind: np.ndarray, key: np.ndarray, *ratio: np.ndarray):
        top = kind == 1
        table = np.stack(ratio, 1).astype(np.int16)
        none = np.zeros((1, table.shape[1]), np.int16)
        self.top, self.top_ratio = HashTable(key[top].view(U)), np.concatenate([table[top], none])
        self.context, self.context_ratio = HashTable(key[~top].view(U)), np.concatenate([table[~top], none])

    def score(self, texts: list[bytes], order: int, half: np.ndarray, passage: int) -> tuple[np.ndarray, ...]:
        """The mean score of both models, that of the model without the text's half, the mean over
        the whole text, and the number of words."""
        keys, word, doc = sequences(texts, order)
        place = self.top.find(keys)
        value = self.top_ratio[place]
        unseen = np.flatnonzero(place < 0)
        value[unseen] = self.context_ratio[self.context.find(keys[unseen] >> U(8))]
        n = np.bincount(doc, minlength=len(texts))
        words = [np.bincount(word, value[:, k], len(doc)) for k in (0, 1)]
        both = [passages(w, n, passage) / STEPS for w in words]
        whole = np.bincount(doc, words[0] + words[1], len(texts)) / 2 / STEPS / np.maximum(n, 1)
        return (both[0] + both[1]) / 2, np.where(half == 0, *both), whole, n


def passages(value: np.ndarray, n: np.ndarray, passage: int) -> np.ndarray:
    """Of texts of n words each, the largest mean of `passage` consecutive words, or the mean of
    a shorter text; 0 for one without words."""
    sums = np.concatenate([[0.0], np.cumsum(value)])
    out = np.zeros(len(n))
    first = np.cumsum(n) - n
    short = np.flatnonzero((n > 0) & (n < passage))
    out[short] = (sums[first[short] + n[short]] - sums[first[short]]) / n[short]
    long = np.flatnonzero(n >= passage)
    if len(long):
        means = (sums[passage:] - sums[:-passage]) / passage
        ends = first[long] + n[long] - passage + 1
        # Windows that run into the next text lie between a text's last window and the next's first.
        bounds = np.stack([first[long], np.minimum(ends, len(means))], 1).reshape(-1)
        padded = np.append(means, -np.inf)
        out[long] = np.maximum.reduceat(padded, bounds)[::2]
    return out


_tables: dict[str, Tables] = {}
SCORES = "doc_id long, score double, held_score double, document_score double, n_words long"


def score(docs: DataFrame, model: DataFrame, order: int = ORDER, ship: int = SHIP, passage: int = PASSAGE) -> DataFrame:
    """SCORES for every row with a doc_id and a text with words."""
    texts = docs.select(id_column(docs), docs["text"].cast("string").alias("text")).where("doc_id is not null and text is not null")
    texts = texts.withColumn("half", _half("doc_id"))
    if model.count() > ship:
        return _score_joined(texts, model, order, passage)
    table = model.toArrow()  # SHIP rows at most
    kinds = {"kind": np.int8, "key": np.int64, "r0": np.int16, "r1": np.int16}
    shipped = docs.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy().astype(k) for c, k in kinds.items()))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _tables:
            _tables.clear()
            _tables[name] = Tables(*shipped.value)
        for batch in batches:
            half = batch.column(2).to_numpy()
            for row, part in blocks(batch.column(1)):
                mean, held, whole, n = _tables[name].score(part, order, half[row : row + len(part)], passage)
                some = np.flatnonzero(n)
                yield pa.record_batch(
                    [batch.column(0).slice(row, len(part)).take(pa.array(some)), *(pa.array(x[some]) for x in (mean, held, whole, n))],
                    ["doc_id", "score", "held_score", "document_score", "n_words"],
                )

    return texts.mapInArrow(run, SCORES)


def _score_joined(texts: DataFrame, model: DataFrame, order: int, passage: int) -> DataFrame:
    """For tables too large to ship: the different words of the corpus are scored by joins, then
    join their places in the texts."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, part in blocks(batch.column(1)):
                w = Words([b" " + t for t in part])
                words = [w.data[a:b].tobytes() for a, b in zip(w.start, w.end)]
                rows = pa.array(w.doc + row)
                at = np.arange(len(words)) - w.first[w.doc]
                yield pa.record_batch([batch.column(0).take(rows), batch.column(3).take(rows), pa.array(at), pa.array(words, pa.binary())], ["doc_id", "r", "at", "word"])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, word, _ = sequences(batch.column(0).to_pylist(), order)
            yield pa.record_batch([batch.column(0).take(pa.array(word)), pa.array(keys.view(np.int64))], ["word", "g"])

    # Rows that repeat a doc_id stay apart by the hash of their text.
    placed = texts.withColumn("r", F.xxhash64("text")).dropDuplicates(["doc_id", "r"]).mapInArrow(places, "doc_id long, r long, at long, word binary")
    grams = placed.select("word").distinct().mapInArrow(spelled, "word binary, g long").withColumn("h", F.shiftright("g", 8))
    tables = {}
    for kind, key in ((1, "g"), (0, "h")):
        tables[key] = model.where(f"kind = {kind}").select(F.col("key").alias(key), *(F.col(c).alias(f"{key}_{c}") for c in ("r0", "r1")))
    joined = grams.join(tables["g"], "g", "left").join(tables["h"], "h", "left")
    value = {c: F.coalesce(f"g_{c}", f"h_{c}", F.lit(0)) for c in ("r0", "r1")}
    words = joined.groupBy("word").agg(*(F.sum(v).alias(f"v{c}") for c, v in value.items()))
    own = W.partitionBy("doc_id", "r")
    window = own.orderBy("at").rowsBetween(0, passage - 1)
    seen = placed.join(words, "word").withColumn("n", F.count("*").over(own)).withColumn("all", F.sum(F.expr("vr0 + vr1")).over(own))
    seen = seen.withColumns({k: F.avg(f"v{k}").over(window) / STEPS for k in ("r0", "r1")})
    whole = seen.where(F.col("at") <= F.greatest(F.lit(0), F.col("n") - passage))
    best = whole.groupBy("doc_id", "r").agg(F.max("r0").alias("r0"), F.max("r1").alias("r1"), F.max("n").alias("n_words"), F.max("all").alias("all"))
    held = F.when(_half("doc_id") == 0, F.col("r0")).otherwise(F.col("r1"))
    document = (F.col("all") / 2 / STEPS / F.col("n_words")).alias("document_score")
    return best.select("doc_id", ((F.col("r0") + F.col("r1")) / 2).alias("score"), held.alias("held_score"), document, "n_words")


def threshold(scores: DataFrame, labels: DataFrame) -> float:
    """The held-out score with the best F1 on all labelled documents, from class counts by step."""
    known = scores.join(
        labels.select(id_column(labels), labels["toxic"].cast("int").alias("toxic")).where("toxic in (0, 1)"), "doc_id"
    )
    step = known.groupBy((F.floor(F.col("held_score") * 2000) / 2000).alias("s")).agg(
        F.sum("toxic").alias("t"), F.count("*").alias("n")
    )
    rows = sorted(((r["s"], r["t"], r["n"]) for r in step.collect()), reverse=True)  # as many as there are steps
    all_toxic = sum(t for _, t, _ in rows)
    best, cut_at, t, n = -1.0, float("inf"), 0, 0
    for k, (s, dt, dn) in enumerate(rows):
        t, n = t + dt, n + dn
        f1 = 2 * t / (n + all_toxic) if n + all_toxic else 0.0
        if f1 >= best and all_toxic:
            # Midway to the next step that holds documents.
            best, cut_at = f1, (s + rows[k + 1][0] + 0.0005) / 2 if k + 1 < len(rows) else s
    return cut_at


def toxic_documents(docs: DataFrame, labels: DataFrame, order: int = ORDER, shared: float = SHARED, passage: int = PASSAGE) -> DataFrame:
    """(doc_id, score, document_score, n_words) of the documents found toxic; scores are in nats a
    word, of the most toxic passage and of the whole document."""
    grams = cut(count(docs, labels, order))
    classes = grams.agg(F.sum(F.expr("t0 + t1")), F.sum(F.expr("o0 + o1"))).first()
    if not (classes[0] and classes[1]):
        return docs.sparkSession.createDataFrame([], "doc_id long, score double, document_score double, n_words long")
    scores = cut(score(docs, cut(ratios(grams, order, shared=shared)), order, passage=passage))
    return scores.where(F.col("score") >= threshold(scores, labels)).groupBy("doc_id").agg(
        F.max("score").alias("score"), *(F.max_by(c, F.struct("score", "document_score", "n_words")).alias(c) for c in ("document_score", "n_words"))
    )
