"""Quality classifier by co-training (Blum and Mitchell, 1998).

Two views of a document: its text (hashed words, character-class bigrams, shapes of words,
repetition) and its metadata (source, lang, length). Each view has a logistic regression; in every round each
classifier labels the documents of a pool of which it is sure for the other, both ways, and
both are fitted again. Then each view is calibrated on held-out labelled documents (Platt),
and a logistic regression of the two calibrated logits, fitted on the same, gives the score.

Fitting uses at most MAX_LABELLED labelled documents, the first by a hash of doc_id, and every
unlabelled one. The features of all are written once, in narrow form; the pool stays in the
executors, where each round scores it with both views and each Newton step adds up its gradients
and Hessians (of a Hessian, which is symmetric, one half), whose size is fixed, in at most TASKS
tasks. Features that no document of the fit has (most buckets of source and lang) are left out of
the fit: their weights are 0. The driver keeps the labelled documents in narrow form too, and widens some at a time. What each view is sure of is cut off by
rank to a step of 1 / STEPS in the logit; equal ranks go in together. Every
document is scored. keep is score >= KEEP, the point where rejecting is the better bet.

Defined results: null text counts as empty, null source or lang as a value of its own; labels
that are null or contradict each other are ignored; null doc_ids are scored but don't train;
rows that repeat are scored like any other, and of the rows of a labelled doc_id the first by its
features trains; texts of any length are read whole; a tie at KEEP is kept; without labels of both kinds every document gets
the score 0.5 and is kept; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, id_column
from .kernel import Words, blocks

MAX_LABELLED, ROUNDS, SURE, KEEP, HELD_OUT = 20_000, 4, 0.97, 0.5, 4
BUCKETS, STEPS, N_STEPS, TASKS, WIDE = 256, 100, 3000, 64, 2048

# Classes of bytes: other marks, lower, upper, digit, space, newline, sentence marks, beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
for _chars, _kind in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t", 4), (b"\n\r", 5), (b".,;:'\"?!-()", 6)):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _kind
_CLASS[128:] = 7
N_SHAPE, N_WORDS = 64 + 8 + 8, 64
N_TEXT = N_SHAPE + N_WORDS


def text_features(texts: list[bytes]) -> np.ndarray:
    n = len(texts)
    w = Words(texts, space=True, fold=False)
    size = np.diff(w.base)
    kind = _CLASS[w.data]
    owner = np.repeat(np.arange(n, dtype=np.int64), size)
    pairs = (owner[:-1] * 64 + kind[:-1] * 8 + kind[1:])[owner[:-1] == owner[1:]]
    bigrams = np.bincount(pairs, minlength=n * 64)[: n * 64].reshape(n, 64) / np.maximum(size, 1)[:, None]
    count = np.maximum(np.diff(w.first), 1)
    length = w.end - w.start
    h = w.hashes()
    last = kind[w.end - 1] if len(h) else np.zeros(0, np.uint8)
    ends = np.bincount(w.doc * 8 + last, minlength=n * 8).reshape(n, 8) / count[:, None]
    shape = np.zeros((n, 8))
    some = np.flatnonzero(np.diff(w.first))
    total = np.bincount(w.doc, length, n)
    shape[:, 0] = total / count / 10
    shape[:, 1] = np.sqrt(np.maximum(0, np.bincount(w.doc, length.astype(float) ** 2, n) / count - (total / count) ** 2)) / 10
    if len(some):
        order = np.lexsort((h, w.doc))
        new = np.append(True, (h[order][1:] != h[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1]))
        shape[:, 2] = np.bincount(w.doc[order][new], minlength=n) / count
        pair = h[:-1] * np.uint64(3) + h[1:]
        inside = w.doc[1:] == w.doc[:-1]
        pair, doc = pair[inside], w.doc[1:][inside]
        order = np.lexsort((pair, doc))
        new = np.append(True, (pair[order][1:] != pair[order][:-1]) | (doc[order][1:] != doc[order][:-1])) if len(pair) else np.zeros(0, bool)
        shape[:, 3] = np.bincount(doc[order][new], minlength=n) / np.maximum(count - 1, 1)
    shape[:, 4] = np.log1p(count) / 10
    shape[:, 5] = np.bincount(w.doc, length == 1, n) / count
    shape[:, 6] = np.bincount(w.doc, length > 20, n) / count
    shape[:, 7] = size <= 1
    # The words themselves, hashed with a sign (so that words of one bucket don't add up).
    lexical = np.bincount(w.doc * N_WORDS + (h >> np.uint64(58)).astype(np.int64), 1.0 - 2.0 * (h & np.uint64(1)).astype(float), n * N_WORDS).reshape(n, N_WORDS) / count[:, None]
    return np.hstack([np.sqrt(bigrams), np.sqrt(ends), shape, np.sign(lexical) * np.sqrt(np.abs(lexical))])


def _buckets(column: int, values: list) -> np.ndarray:
    at = {value: xxhash.xxh64_intdigest(f"{column}{value!r}") % BUCKETS for value in set(values)}
    return np.fromiter((at[value] for value in values), np.int64, len(values))


def meta_of(source: np.ndarray, lang: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One-hots of the buckets of source and lang, and the length in steps and as it is."""
    out = np.zeros((len(size), BUCKETS + 14))
    row = np.arange(len(size))
    out[row, source] = 1
    out[row, lang] = 1
    out[row, BUCKETS + np.minimum(11, np.log2(size + 1).astype(int) * 3 // 4)] = 1
    out[:, BUCKETS + 12] = np.log1p(size) / 10
    out[:, BUCKETS + 13] = (np.log1p(size) / 10) ** 2
    return out


def meta_features(source: list, lang: list, size: np.ndarray) -> np.ndarray:
    return meta_of(_buckets(0, source), _buckets(1, lang), size)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """Of batches (doc_id, text, source, lang, ...): both views of some rows at a time."""
    for batch in batches:
        for row, texts in blocks(batch.column(1)):
            source, lang = (batch.column(k).slice(row, len(texts)).to_pylist() for k in (2, 3))
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            yield batch, row, text_features(texts), meta_features(source, lang, size)


NARROW = "doc_id long, x binary, source long, lang long, size long"


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, texts in blocks(batch.column(1)):
            x = text_features(texts).astype(np.float32)
            source, lang = (_buckets(k, batch.column(2 + k).slice(row, len(texts)).to_pylist()) for k in (0, 1))
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.record_batch(
                [batch.column(0).slice(row, len(texts)), pa.array([v.tobytes() for v in x], pa.binary()), *map(pa.array, (source, lang, size))],
                [c.split()[0] for c in NARROW.split(", ")],
            )


def _text(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, N_TEXT)


def _wide(rows: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    """Both views of rows of NARROW."""
    return [_text(rows).astype(float), meta_of(*(rows[c].to_numpy() for c in ("source", "lang", "size")))]


def _parts(rows: pa.RecordBatch | pa.Table) -> Iterator[pa.RecordBatch | pa.Table]:
    """Some rows at a time, few enough to be widened."""
    for row in range(0, rows.num_rows, WIDE):
        yield rows.slice(row, WIDE)


class Pool:
    """The unlabelled documents, rows of NARROW, of which only sums leave the executors."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.coalesce(TASKS)

    def add(self, of: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray | float:
        """The sum of `of` both views over all rows, 0 without any."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for rows in _parts(batch):
                    part = of(_wide(rows))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["s"])

        parts = self.rows.mapInArrow(run, "s binary").toArrow()["s"]  # TASKS at most
        return sum((np.frombuffer(part.as_py()) for part in parts), 0.0)


def _moments(views: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([[len(views[0])], *(v.sum(0) for v in views), *((v * v).sum(0) for v in views)])


def _standard(views: list[np.ndarray], used: list[np.ndarray], mean: list[np.ndarray], scale: list[np.ndarray]) -> list[np.ndarray]:
    """The columns `used` of both views, standardised."""
    return [(v[:, u] - m) / s for v, u, m, s in zip(views, used, mean, scale)]


def _step(z: np.ndarray, sure: float) -> np.ndarray:
    """The steps by which a logit is above that of `sure`; -1 below."""
    over = z - np.log(sure / (1 - sure))
    return np.where(over < 0, -1, np.minimum(N_STEPS - 1, np.maximum(over, 0) * STEPS)).astype(int)


def _ranks(views: list[np.ndarray], beta: list[np.ndarray], sure: float) -> np.ndarray:
    """How many documents each view puts on each step, of label 0 and of label 1."""
    out = []
    for b, v in zip(beta, views):
        z = apply(b, v)
        for own in (_step(-z, sure), _step(z, sure)):
            out.append(np.bincount(own[own >= 0], minlength=N_STEPS))
    return np.concatenate(out).astype(float)


def _guesses(views: list[np.ndarray], history: list[tuple], sure: float) -> list[np.ndarray]:
    """What each view has learned from the other in the rounds so far; -1 without a label.
    history: the views' weights, and the first steps taken by view and label, of each round."""
    out = [np.full(len(v), -1) for v in views]
    for beta, first in history:
        for v in (0, 1):
            z = apply(beta[v], views[v])
            for label, own in ((1, z), (0, -z)):
                out[1 - v][_step(own, sure) >= first[v][label]] = label
    return out


def _slopes(views: list[np.ndarray], target: list[np.ndarray], beta: list[np.ndarray]) -> np.ndarray:
    """Gradients and the upper halves of the Hessians of both views' likelihoods over the rows with a target."""
    out = []
    for v, y, b in zip(views, target, beta):
        own = y >= 0
        part = np.ones((int(own.sum()), len(b)))
        part[:, :-1] = v[own]
        p = _sigmoid(part @ b)
        out.append(part.T @ (y[own] - p))
        part *= np.sqrt(np.maximum(p * (1 - p), 1e-6))[:, None]
        out.append((part.T @ part)[np.triu_indices(len(b))])
    return np.concatenate(out)


def _both(labelled: pa.Table, pool: Pool, shape: tuple, history: list[tuple], beta: list[np.ndarray], sure: float, ridge: float = 1.0, steps: int = 25) -> list[np.ndarray]:
    """Weights of both views by Newton's method, as logistic() has them, over labelled rows and
    the pool with its guessed labels."""

    def of(part: list[np.ndarray]) -> np.ndarray:
        part = _standard(part, *shape)
        return _slopes(part, _guesses(part, history, sure), beta)

    for _ in range(steps):
        total = pool.add(of) if history else 0.0
        for part in _parts(labelled):
            total = total + _slopes(_standard(_wide(part), *shape), [part["y"].to_numpy()] * 2, beta)
        moved, at, after = 0.0, 0, []
        for b in beta:
            d = len(b)
            penalty = np.full(d, ridge)
            penalty[-1] = 1e-3
            half = np.zeros((d, d))
            half[np.triu_indices(d)] = total[at + d : at + d + d * (d + 1) // 2]
            gradient, hessian = total[at : at + d], half + np.triu(half, 1).T
            at += d + d * (d + 1) // 2
            step = np.linalg.solve(hessian + np.diag(penalty), gradient - penalty * b)
            most = np.abs(step).max()
            after.append(b + step * min(1.0, 5 / max(1e-9, most)))
            moved = max(moved, most)
        beta = after
        if moved < 1e-5:
            break
    return beta


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25, block: int = 4096) -> np.ndarray:
    """Weights, the intercept last, by Newton's method; the intercept isn't penalised. Sums are
    taken block by block, in double precision."""
    n, d = x.shape
    penalty = np.full(d + 1, ridge)
    penalty[-1] = 1e-3
    beta = np.zeros(d + 1)
    for _ in range(steps):
        gradient, hessian = -penalty * beta, np.diag(penalty)
        for row in range(0, n, block):
            part = np.ones((min(block, n - row), d + 1))
            part[:, :-1] = x[row : row + block]
            p = _sigmoid(part @ beta)
            gradient += part.T @ (y[row : row + block] - p)
            hessian += part.T @ (part * np.maximum(p * (1 - p), 1e-6)[:, None])
        step = np.linalg.solve(hessian, gradient)
        beta += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-5:
            break
    return beta


def apply(beta: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ beta[:-1] + beta[-1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """Both views' classifiers, standardisation and calibration, and how they are combined."""

    def __init__(self, labelled: pa.Table, pool: Pool, rounds: int = ROUNDS, sure: float = SURE):
        """labelled: rows of NARROW with y, 1 or 0."""
        y = labelled["y"].to_numpy()
        self.ok = bool((y == 1).any() and (y == 0).any())
        if not self.ok:
            return
        width = [N_TEXT, BUCKETS + 14]
        (n,), *sums = np.split(sum((_moments(_wide(part)) for part in _parts(labelled)), pool.add(_moments)), np.cumsum([1, *width, *width])[:-1])
        self.mean = [m / n for m in sums[:2]]
        self.scale = [np.maximum(np.sqrt(np.maximum(0, q / n - m**2)), 1e-3) for q, m in zip(sums[2:], self.mean)]
        used = [np.flatnonzero(q) for q in sums[2:]]
        shape = used, [m[u] for m, u in zip(self.mean, used)], [s[u] for s, u in zip(self.scale, used)]
        n_pool = int(n) - len(y)
        place = np.arange(len(y))
        held = place[::HELD_OUT] if len(place) >= 8 * HELD_OUT else place
        fit = np.setdiff1d(place, held) if len(place) >= 8 * HELD_OUT else place
        if len(np.unique(y[fit])) < 2 or len(np.unique(y[held])) < 2:
            fit = held = place
        share = y[fit].mean()
        fitted, held = labelled.take(fit), labelled.take(held)
        self.rounds: list[tuple[int, int]] = []
        history: list[tuple] = []
        beta = [np.zeros(len(u) + 1) for u in used]
        for turn in range(rounds + 1):
            beta = _both(fitted, pool, shape, history, beta, sure)
            if turn == rounds or not n_pool:
                break
            ranks = pool.add(lambda part, beta=beta: _ranks(_standard(part, *shape), beta, sure)).reshape(2, 2, N_STEPS)
            # At most a growing part of the pool, in the proportion of the labels.
            most = max(1, n_pool * (turn + 1) // (2 * rounds))
            first = np.zeros((2, 2), int)
            given = [0, 0]
            for v in (0, 1):
                for label, part in ((1, share), (0, 1 - share)):
                    above = np.cumsum(ranks[v, label, ::-1])[::-1]
                    enough = np.flatnonzero(above >= max(1, int(most * part)))
                    first[v, label] = enough[-1] if len(enough) else 0
                    given[v] += int(above[first[v, label]])
            history.append((beta, first))
            self.rounds.append(tuple(given))
        # Platt scaling of each view, then their logits together.
        logit = np.concatenate([np.stack([apply(b, v) for b, v in zip(beta, _standard(_wide(part), *shape))], 1) for part in _parts(held)])
        y = held["y"].to_numpy().astype(float)
        self.platt = [logistic(logit[:, [v]], y) for v in (0, 1)]
        both = np.stack([apply(c, logit[:, [v]]) for v, c in enumerate(self.platt)], 1)
        self.joint = logistic(np.clip(both, -12, 12), y)
        self.beta = [np.zeros(d + 1) for d in width]
        for all_, u, b in zip(self.beta, used, beta):
            all_[np.append(u, -1)] = b

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """score, text view's and metadata view's calibrated probability."""
        if not self.ok:
            return np.full((3, len(text)), 0.5)
        z = []
        for v, x in enumerate((text, meta)):
            x = (x - self.mean[v]) / self.scale[v]
            z.append(apply(self.platt[v], apply(self.beta[v], x)[:, None]))
        joint = apply(self.joint, np.clip(np.stack(z, 1), -12, 12))
        return np.stack([_sigmoid(joint), _sigmoid(z[0]), _sigmoid(z[1])])


def _columns(docs: DataFrame) -> DataFrame:
    there = {c: docs[c].cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("text", "source", "lang")}
    return docs.select(id_column(docs), *(c.alias(k) for k, c in there.items()))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> Model:
    known = (
        labels.select(id_column(labels), labels["quality"].cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
        .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    )
    rows = _columns(docs).where("doc_id is not null").mapInArrow(_narrow, NARROW)
    rows = cut(rows.join(known, "doc_id", "left"))  # features are shuffled, no text
    chosen = rows.where("y is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # One row of each drawn id, so that no id that repeats sends more than its share.
    one = rows.join(F.broadcast(chosen), "doc_id", "left_semi").where("y is not null").groupBy("doc_id").agg(F.min(F.struct("x", "source", "lang", "size", "y")).alias("r"))
    labelled = one.select("doc_id", "r.*").toArrow()
    # The rows' order depends on how the job ran; the model must not.
    x, y = _text(labelled), labelled["y"].to_numpy()
    labelled = labelled.take(np.lexsort((y, *x[:, :8].T, *x[:, 60:90].T)))
    return Model(labelled, Pool(rows.where("y is null").drop("y")), rounds)


def score(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """(doc_id, score, text_score, meta_score, keep) for every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, text, meta in _features(batches):
            s = shipped.value.score(text, meta)
            yield pa.record_batch([batch.column(0).slice(row, len(text)), *map(pa.array, s), pa.array(s[0] >= keep)], ["doc_id", "score", "text_score", "meta_score", "keep"])

    return _columns(docs).mapInArrow(run, "doc_id long, score double, text_score double, meta_score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The documents with at least that score, unchanged; each row is judged by itself."""
    model = train(docs, labels)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    places = [docs.columns.index(c) if c in docs.columns else None for c in ("text", "source", "lang")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = pa.nulls(batch.num_rows, pa.string())
            view = [batch.column(0), *(none if p is None else batch.column(p).cast(pa.string()) for p in places)]
            part = pa.record_batch(view, ["doc_id", "text", "source", "lang"])
            good = [shipped.value.score(t, m)[0] >= keep for _, _, t, m in _features([part])]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(run, docs.schema)
