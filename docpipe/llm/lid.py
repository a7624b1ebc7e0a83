"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The likelihood
of a word is the sum over all ways of cutting it into pieces of the product of their
probabilities, by the forward algorithm; a text's is the product over its words. Training is
expectation-maximisation over all labelled documents. Their distinct words are counted once by
language; every round then computes expected counts of pieces (forward and backward) for these
words under each language's own probabilities, and only language x vocabulary sums leave a task.
Rounds end when the mean log-likelihood of a word gains less than GAIN of itself, at MAX_ROUNDS
at the latest. The model's size is fixed by the vocabulary and the number of languages, of which
there may be MAX_LANGS; more are an error, as then lang is no language.

Words are runs of non-space bytes with a mark in front for the space, case folded; the marks
and the bytes of unknown characters are pieces too, so that every word has a segmentation.

Defined results: null, empty and blank texts and empty tables of labels give a null language
and zero confidence; a tie goes to the alphabetically first language; rows without a lang or
text don't train; null doc_ids and repeated rows are scored like any other; texts and words
of any length are summed whole; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import cut, id_column
from .kernel import BLOCK, HashTable, U, Words, _BYTE_HASH, blocks, mix, powers, prefix, span

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK, LONGEST, SMOOTH, MAX_ROUNDS, GAIN, MAX_LANGS = 0x20, 63, 0.1, 20, 1e-3, 1000
CACHE = 1 << 18


class Pieces:
    """The vocabulary's pieces as bytes; the space mark is one byte."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {bytes([b]) for b in range(256)}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                piece = model.id_to_piece(i).lower().replace("▁", " ").encode()
                if len(piece) > LONGEST:
                    raise ValueError(f"a piece of more than {LONGEST} bytes: {piece!r}")
                if piece.count(b" ") - piece.startswith(b" ") == 0:
                    found.add(piece)
        self.pieces = sorted(found)
        data = np.frombuffer(b"".join(self.pieces), np.uint8)
        ends = np.cumsum([len(p) for p in self.pieces])
        self.length = np.array(list(map(len, self.pieces)))
        self.longest = int(self.length.max())
        sums, start = prefix(_BYTE_HASH[data]), ends - self.length
        self.table = HashTable(span(sums, start, ends))
        # By 21 bits of the hash: one piece that has them, and whether the start of a piece may.
        self.at = np.full(1 << 21, -1, np.int32)
        self.at[self._slot(self.table.keys)] = np.arange(len(self.pieces))
        self.begins = np.zeros(1 << 21, bool)
        for n in range(1, self.longest):
            own = start[self.length > n]
            self.begins[self._slot(span(sums, own, own + n))] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys >> U(43)).astype(np.int64)

    def edges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """sums: prefix sums of the words' data. (word, from, to, piece) of every piece that occurs in a word, ordered by `to`;
        from and to count bytes within the word."""
        size = end - start
        word = np.repeat(np.arange(len(start)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        there, left = np.repeat(start, size) + at, np.repeat(size, size) - at
        # head, scale: of the hash of what begins at a place, all that doesn't depend on its end.
        head, scale, place = sums[there], powers(len(sums))[1][there], np.arange(len(there))
        found = []
        for n in range(1, self.longest + 1):
            if not len(place):
                break
            keys = mix((sums[there + n] - head) * scale)
            slot = self._slot(keys)
            piece = self.at[slot]
            seen = np.flatnonzero(piece >= 0)
            piece = piece[seen].astype(np.int64)
            other = np.flatnonzero(self.table.keys[piece] != keys[seen])
            if len(other):
                piece[other] = self.table.find(keys[seen[other]])
                seen, piece = seen[piece >= 0], piece[piece >= 0]
            here = place[seen]
            found.append((word[here], at[here], at[here] + n, piece))
            # Places at which no longer piece can begin are done.
            keep = np.flatnonzero(self.begins[slot] & (left > n))
            there, left, head, scale, place = there[keep], left[keep], head[keep], scale[keep], place[keep]
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        joined = [np.concatenate(x) for x in zip(*found)]
        order = np.argsort(joined[2].astype(np.uint16) if joined[2].max(initial=0) < 65536 else joined[2], kind="stable")
        return tuple(x[order] for x in joined)


PLAIN, LIFT, CHUNK = 96, 20.0, 6000


def _chunks(size: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
    """Words by size, few enough at a time for the processor's caches; and whether _plain
    may have them."""
    order = np.argsort(size, kind="stable")
    plain = int(np.searchsorted(size[order], PLAIN, "right"))
    for low, high, yes in ((0, plain, True), (plain, len(order), False)):
        for row in range(low, high, CHUNK):
            yield order[row : min(row + CHUNK, high)], yes


def _plain(edges: tuple, size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Forward sums of words of at most PLAIN bytes, by byte; the sum at byte j is lifted by
    LIFT**j, as p is by the length of the piece, which keeps it within a double's range."""
    word, a, b, piece = edges
    base = np.concatenate([[0], np.cumsum(size + 1)])
    alpha = np.zeros((base[-1], p.shape[1]))
    alpha[base[:-1]] = 1
    key = b * 64 + (b - a)  # no word twice in a run: sums need no scatter
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else []
    source, target = base[word] + a, base[word] + b
    if p.shape[1] == 1:
        one, weight = alpha[:, 0], p[:, 0][piece]
        for lo, hi in zip(cut, np.append(cut[1:], len(key)) if len(key) else []):
            one[target[lo:hi]] += one[source[lo:hi]] * weight[lo:hi]
        return alpha
    for lo, hi in zip(cut, np.append(cut[1:], len(key)) if len(key) else []):
        at = target[lo:hi]
        alpha[at] = alpha.take(at, 0) + alpha.take(source[lo:hi], 0) * p.take(piece[lo:hi], 0)
    return alpha


def _logs(edges: tuple, size: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """The same for words of any length, as logarithms."""
    word, a, b, piece = edges
    base = np.concatenate([[0], np.cumsum(size + 1)])
    alpha = np.full((base[-1], logp.shape[1]), -np.inf)
    alpha[base[:-1]] = 0
    cut = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else []
    for lo, hi in zip(cut, np.append(cut[1:], len(b)) if len(b) else []):
        w = word[lo:hi]
        order = np.argsort(w, kind="stable")
        w, value = w[order], (alpha[base[w] + a[lo:hi]] + logp[piece[lo:hi]])[order]
        head = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        top = np.maximum.reduceat(value, head)
        total = np.add.reduceat(np.exp(value - np.repeat(top, np.diff(np.append(head, len(w))), axis=0)), head)
        alpha[base[w[head]] + b[lo]] = top + np.log(total)
    return alpha


def likelihood(p: Pieces, data: np.ndarray, start: np.ndarray, end: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word in each language."""
    size, sums = end - start, prefix(_BYTE_HASH[data])
    out = np.zeros((len(start), logp.shape[1]))
    lifted = np.exp(logp + p.length[:, None] * np.log(LIFT))
    for rows, plain in _chunks(size):
        edges, own = p.edges(sums, start[rows], end[rows]), size[rows]
        last = np.cumsum(own + 1) - 1
        if plain:
            out[rows] = np.log(_plain(edges, own, lifted)[last]) - own[:, None] * np.log(LIFT)
        else:
            out[rows] = _logs(edges, own, logp)[last]
    return out


def expected(p: Pieces, data: np.ndarray, start: np.ndarray, end: np.ndarray, logp: np.ndarray, weight: np.ndarray, sums: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Expected counts of the pieces, the word w counting weight[w] times, and the words'
    log-likelihood. logp has one column. sums: prefix sums of data, if there already."""
    size, sums = end - start, prefix(_BYTE_HASH[data]) if sums is None else sums
    out, total = np.zeros(len(p.pieces)), 0.0
    lifted = np.exp(logp + p.length[:, None] * np.log(LIFT))
    for rows, plain in _chunks(size):
        edges, own = p.edges(sums, start[rows], end[rows]), size[rows]
        word, a, b, piece = edges
        # Backward sums are the forward sums of the mirrored lattice.
        key = (own[word] - a) * 64 + np.minimum(b - a, 63)
        order = np.argsort(key.astype(np.uint16) if plain else key, kind="stable")
        back = tuple(x[order] for x in (word, own[word] - b, own[word] - a, piece))
        base = np.concatenate([[0], np.cumsum(own + 1)])
        at, rest, whole = base[word] + a, base[word] + own[word] - b, base[word + 1] - 1
        if plain:
            alpha, beta = _plain(edges, own, lifted)[:, 0], _plain(back, own, lifted)[:, 0]
            posterior = alpha[at] * lifted[piece, 0] * beta[rest] / alpha[whole]
            total += float((weight[rows] * (np.log(alpha[np.cumsum(own + 1) - 1]) - own * np.log(LIFT))).sum())
        else:
            alpha, beta = _logs(edges, own, logp)[:, 0], _logs(back, own, logp)[:, 0]
            posterior = np.exp(alpha[at] + logp[piece, 0] + beta[rest] - alpha[whole])
            total += float((weight[rows] * alpha[np.cumsum(own + 1) - 1]).sum())
        out += np.bincount(piece, posterior * weight[rows[word]], len(p.pieces))
    return out, total


def marked_words(texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words, their hashes, and data in which the byte before each word is the mark."""
    w = Words([b" " + t for t in texts], space=True)
    data = w.data.copy()
    data[w.start - 1] = MARK
    start = w.start - 1
    return w, span(prefix(_BYTE_HASH[data]), start, w.end), data, start


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to (lang, word, n), summed over some texts at a time."""
    for batch in batches:
        coded = pc.fill_null(batch.column(0), "").dictionary_encode()
        langs = coded.indices.to_numpy(zero_copy_only=False)
        for row, texts in blocks(batch.column(1), 2 * BLOCK):
            w, keys, data, start = marked_words(texts)
            if not len(keys):
                continue
            own = langs[row : row + len(texts)][w.doc]
            order = np.argsort(keys ^ mix(own.astype(U) + U(1)))
            key, lang = keys[order], own[order]
            head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (lang[1:] != lang[:-1])))
            one = order[head]
            size = w.end[one] - start[one]
            edge = np.append(0, np.cumsum(size))
            held = data[np.arange(edge[-1]) + np.repeat(start[one] - edge[:-1], size)]
            word = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(held)])
            yield pa.record_batch([coded.dictionary.take(pa.array(own[one])), word, pa.array(np.diff(np.append(head, len(order))))], ["lang", "word", "n"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows (lang, word, n) in batches of about BLOCK bytes or more."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BLOCK:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _spans(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, data, start, end) of words without nulls, as blocks() has them."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + BLOCK, "right")) - 1)
        own = ends[row : stop + 1] - ends[row]
        yield row, np.frombuffer(column.buffers()[2], np.uint8)[ends[row] : ends[stop]], own[:-1], own[1:]
        row = stop


def _expect(vocabulary: str, model: Callable[[], tuple[list[str], np.ndarray] | None]):
    """(lang, word, n) to (lang, piece, n): expected counts; piece -1 has the log-likelihood and
    -2 the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, known, sums = pieces(vocabulary), model(), {}
        n = len(p.pieces)
        for batch in _joined(batches):
            coded = batch.column(0).dictionary_encode()
            langs, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            weights = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            for row, data, start, end in _spans(batch.column(1)):
                there, weight, hashed = langs[row : row + len(start)], weights[row : row + len(start)], prefix(_BYTE_HASH[data])
                for k in np.unique(there).tolist():
                    x, own = names[k], np.flatnonzero(there == k)
                    logp = np.full((n, 1), -np.log(n)) if known is None else known[1][:, [known[0].index(x)]]
                    counts, fit = expected(p, data, start[own], end[own], logp, weight[own], hashed)
                    total = sums.setdefault(x, np.zeros(n + 2))
                    total[:n] += counts
                    total[n:] += fit, weight[own].sum()
        for x, total in sums.items():
            some = np.append(np.flatnonzero(total[:n]), [n, n + 1])
            piece = np.where(some < n, some, n - 1 - some)
            yield pa.record_batch([pa.array([x] * len(some)), pa.array(piece.astype(np.int32)), pa.array(total[some])], ["lang", "piece", "n"])

    return run


def train(docs: DataFrame, vocabulary: str = VOCABULARY, max_rounds: int = MAX_ROUNDS, gain: float = GAIN) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (pieces x languages), from all rows with a lang."""
    spark = docs.sparkSession
    rows = docs.select(docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text")).where("lang is not null and text is not null")
    words = cut(rows.mapInArrow(_count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = sorted(r["lang"] for r in words.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"lang has more than {MAX_LANGS} values")
    place = {x: k for k, x in enumerate(langs)}
    n = len(pieces(vocabulary).pieces)
    model: tuple[list[str], np.ndarray] | None = None
    before = -np.inf
    for _ in range(max_rounds if langs else 0):
        shipped = spark.sparkContext.broadcast(model)
        summed = words.mapInArrow(_expect(vocabulary, lambda shipped=shipped: shipped.value), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        got = summed.toArrow()  # languages x vocabulary at most
        piece, count = got["piece"].to_numpy(), got["n"].to_numpy()
        lang = np.array([place[x] for x in got["lang"].to_pylist()])
        table = np.full((n, len(langs)), SMOOTH)
        table[piece[piece >= 0], lang[piece >= 0]] += count[piece >= 0]
        fit = count[piece == -1].sum() / count[piece == -2].sum()
        model = (langs, np.log(table / table.sum(0)))
        if fit - before < gain * abs(fit):
            break
        before = fit
    return model if model else ([], np.zeros((0, 0)))


class Scorer:
    """Log-likelihoods of texts; distinct words are scored once, frequent ones from a cache."""

    def __init__(self, p: Pieces, logp: np.ndarray):
        self.p, self.logp = p, logp
        self.known, self.scores = HashTable(np.zeros(0, U)), np.zeros((0, logp.shape[1]))

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages), and the number of words."""
        w, keys, data, start = marked_words(texts)
        place = self.known.find(keys)
        new, scores = np.flatnonzero(place < 0), self.scores
        if len(new):
            unique, one, which = np.unique(keys[new], return_index=True, return_inverse=True)
            one = new[one]
            more = likelihood(self.p, data, start[one], w.end[one], self.logp)
            place[new] = len(scores) + which
            scores = np.concatenate([scores, more])
            if len(self.scores) < CACHE:
                self.known, self.scores = HashTable(np.concatenate([self.known.keys, unique])), scores
        sums = np.zeros((len(keys) + 1, self.logp.shape[1]))
        np.cumsum(scores[place], axis=0, out=sums[1:])
        return sums[w.first[1:]] - sums[w.first[:-1]], np.diff(w.first)


_scorers: dict[str, Scorer] = {}


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, predicted, confidence, n_words) for every row; confidence is the posterior
    under equal priors."""
    langs, logp = model
    shipped = docs.sparkSession.sparkContext.broadcast(logp)
    name = uuid.uuid4().hex  # a worker keeps its word scores from task to task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if langs and name not in _scorers:
            _scorers.clear()
            _scorers[name] = Scorer(pieces(vocabulary), shipped.value)
        scorer = _scorers[name] if langs else None
        for batch in batches:
            ids = batch.column(0)
            for row, texts in blocks(batch.column(1)):
                if scorer is None:
                    best, sure, words = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), int)
                else:
                    score, words = scorer.score(texts)
                    best = score.argmax(1)
                    sure = 1 / np.exp(score - score.max(1, keepdims=True)).sum(1)
                none = words == 0
                names = np.array([*langs, ""], object)[best] if langs else np.array([""] * len(texts), object)
                yield pa.record_batch(
                    [ids.slice(row, len(texts)), pa.array(names, pa.string(), mask=none), pa.array(np.where(none, 0.0, sure)), pa.array(words.astype(np.int32))],
                    ["doc_id", "predicted", "confidence", "n_words"],
                )

    texts = docs.select(id_column(docs), docs["text"].cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, predicted string, confidence double, n_words int")
