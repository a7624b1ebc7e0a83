"""Byte-level BPE, encoding and decoding, in numpy.

A text is cut into pieces by character classes: each run of letters, numbers or other marks
with at most one space before it, the contractions 's 't 're 've 'm 'll 'd, and the rest of
the white space, as the public pattern of such vocabularies has it. Distinct pieces of a
batch go into padded matrices of one length bucket each; in every round each row merges the
leftmost pair of least rank, found in a hash table of pairs, and rows are compacted. A piece of
more than WIDE bytes merges all its pairs of least rank in a round, in the same order. Pieces
are looked up by hash again in later batches, so a piece is merged once per task.

The vocabulary is a file of base64 tokens and ranks, given by path; every single byte must be
in it. Defined results: null text has null tokens, empty text none; the round trip is exact
for every text; null doc_ids and repeated rows are encoded like any other; further columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_column
from .kernel import HashTable, U, _BYTE_HASH, blocks, prefix, span

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE, WIDE = 1 << 18, 256
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
SCHEMA = "doc_id long, tokens array<int>, n_tokens int, decoded_equal boolean"


_WHITE = np.array([*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_UNSEEN = 255
_classes = np.full(sys.maxunicode + 1, _UNSEEN, np.uint8)
_classes[_WHITE] = SPACE


def _kinds(code: np.ndarray) -> np.ndarray:
    """Class of each character; a character is looked up when it is first seen."""
    kind = _classes[code]
    if (new := kind == _UNSEEN).any():
        for c in np.unique(code[new]).tolist():
            _classes[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
        kind = _classes[code]
    return kind


def pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joined bytes, where in them the pieces start, and the first piece of each text with
    the count of pieces at the end. The texts are valid UTF-8."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size)
    head = np.flatnonzero((data & 0xC0) != 0x80)  # byte of each character
    code = np.frombuffer(b"".join(texts).decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(code)
    if not n:
        return data, np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    begins = np.searchsorted(head, np.concatenate([[0], ends]))  # first character of each text
    kind = _kinds(code)
    text_start = np.zeros(n + 1, bool)
    text_start[begins] = True
    change = text_start[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    # White space before something else of the same text gives up its last character ...
    run = np.flatnonzero(change)
    last = np.append(run[1:], n) - 1
    gives = (kind[run] == SPACE) & ~text_start[last + 1]
    start = change.copy()
    start[last[gives]] = True
    # ... which, if it is a space, opens the next piece.
    opens = last[gives & (code[last] == 0x20)]
    start[opens + 1] = False
    # Contractions: an apostrophe that is a piece of its own, and one or two letters.
    quote = np.flatnonzero((code == 0x27) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~text_start[quote + 1]]
    if len(quote):
        one = code[quote + 1]
        two = np.where(quote + 2 < n, code[np.minimum(quote + 2, n - 1)], 0)
        two[text_start[np.minimum(quote + 2, n)]] = 0
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[quote[short | long] + 1] = False
        for mask, step in ((short, 2), (long & ~short, 3)):
            after = quote[mask] + step
            after = after[after < n]
            start[after] = True
            # A space that was to open a piece still does: only letters are cut here.
    places = np.flatnonzero(start)
    return data, head[places], np.searchsorted(places, begins)


class Codec:
    def __init__(self, path: str):
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        self.token = {r: t for t, r in by_rank}
        size = by_rank[-1][1] + 1
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs, merged = [], []
        for token, rank in by_rank:
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    merged.append(rank)
        self.pairs, self.merged = HashTable(np.array(pairs, U)), np.array(merged, np.int32)
        lengths = np.array([len(self.token.get(r, b"")) for r in range(size)])
        self.length, self.offset = lengths, np.concatenate([[0], np.cumsum(lengths)])
        self.bytes = np.frombuffer(b"".join(self.token.get(r, b"") for r in range(size)), np.uint8)
        self.known = HashTable(np.zeros(0, U))
        self.known_start, self.known_ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def merge(self, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of token ids padded with -1, all merged to the end."""
        rows, size = rows.copy(), size.copy()
        worst = np.iinfo(np.int32).max

        def ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            place = self.pairs.find((left.astype(U) << U(32)) | right.astype(U))
            return np.where(place >= 0, self.merged[place], worst)

        rank = np.full((len(rows), max(1, rows.shape[1] - 1)), worst, np.int32)
        valid = rows[:, 1:] >= 0
        rank[:, : rows.shape[1] - 1][valid] = ranks(rows[:, :-1][valid], rows[:, 1:][valid])
        done, part, width = np.arange(len(rows)), rows, size
        while len(done):
            at = rank.argmin(1)  # the leftmost of equal ranks
            line = np.arange(len(part))
            best = rank[line, at]
            going = best < worst
            if not going.all():  # finished rows leave, the rest moves together
                rows[done[~going], : part.shape[1]] = part[~going]
                size[done[~going]] = width[~going]
                done, part, rank, width = done[going], part[going], rank[going], width[going]
                at, best = at[going], best[going]
                if not len(done):
                    break
                line = np.arange(len(part))
            # Close the gap behind the merged pair, then rank its two new neighbourhoods.
            columns = np.arange(part.shape[1])
            source = np.minimum(columns + (columns > at[:, None]), part.shape[1] - 1)
            part = np.take_along_axis(part, source, 1)
            part[line, at] = best
            width = width - 1
            part[line, width] = -1
            columns = columns[:-1]
            source = np.minimum(columns + (columns >= at[:, None]), rank.shape[1] - 1)
            rank = np.take_along_axis(rank, source, 1)
            rank[line, np.maximum(width - 1, 0)] = worst
            for k in (at - 1, at):
                there = np.flatnonzero((k >= 0) & (k + 1 < width))
                rank[there, k[there]] = ranks(part[there, k[there]], part[there, k[there] + 1])
        return rows, size

    def merge_wide(self, row: np.ndarray) -> np.ndarray:
        """One long row of token ids, merged to the end with the same result. A round merges all
        pairs of the least rank from the left, up to one that opens a pair of lower rank, which
        would have to go first. Merged tokens are unlinked; the row is compacted when half are."""
        worst = np.iinfo(np.int32).max

        def ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            place = self.pairs.find((left.astype(U) << U(32)) | right.astype(U))
            return np.where(place >= 0, self.merged[place], worst)

        ids = row.astype(np.int64)
        while len(ids) > 1:
            n = len(ids)
            after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
            rank = np.append(ranks(ids[:-1], ids[1:]), worst).astype(np.int32)
            gone = np.zeros(n, bool)
            n_gone = 0
            while 2 * n_gone <= n and (best := int(rank.min())) < worst:
                at = np.flatnonzero(rank == best)
                # Of pairs that overlap every second one goes.
                chain = np.append(True, after[at[:-1]] != at[1:])
                run = np.maximum.accumulate(np.where(chain, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
                follows = after[after[at]]  # behind each pair, as it stands when the pair merges
                right = np.where(follows < n, ranks(np.full(len(at), best), ids[np.minimum(follows, n - 1)]), worst)
                ahead = before[at]
                merged_ahead = np.append(False, after[after[at[:-1]]] == at[1:])
                own = np.where(merged_ahead, best, ids[np.maximum(ahead, 0)])
                left = np.where(ahead >= 0, ranks(own, np.full(len(at), best)), worst)
                early = np.flatnonzero((left < best) | (right < best))
                if len(early):
                    at = at[: early[0] + 1]
                second = after[at]
                ids[at] = best
                gone[second] = True
                rank[second] = worst
                n_gone += len(at)
                after[at] = after[second]
                there = after[at] < n
                before[after[at][there]] = at[there]
                for k in (before[at], at):
                    k = k[k >= 0]
                    follow = after[k]
                    rank[k] = np.where(follow < n, ranks(ids[k], ids[np.minimum(follow, n - 1)]), worst)
            ids = ids[~gone]
            if 2 * n_gone <= n:
                break
        return ids.astype(np.int32)

    def _encode_pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the pieces, joined, and where each begins."""
        length = end - start
        order = np.argsort(length, kind="stable")
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(order)
        counts = np.zeros(len(order), np.int64)
        row = 0
        while row < len(order):
            width = int(length[order[row]])
            bucket = max(width, 1 << (width - 1).bit_length()) if width > 16 else width
            stop = int(np.searchsorted(length[order], bucket, "right"))
            stop = min(stop, row + max(1, 2_000_000 // bucket))
            chosen = order[row:stop]
            if width > WIDE:
                for c in chosen:
                    out[c] = self.merge_wide(self.byte_id[data[start[c] : end[c]]])
                    counts[c] = len(out[c])
                row = stop
                continue
            column = np.arange(int(length[chosen].max()))
            at = start[chosen][:, None] + column
            inside = column < length[chosen][:, None]
            rows = np.where(inside, self.byte_id[data[np.where(inside, at, 0)]], -1).astype(np.int32)
            rows, size = self.merge(rows, length[chosen])
            kept = rows[:, : size.max()]
            flat = kept[kept >= 0].astype(np.int32)
            edge = np.concatenate([[0], np.cumsum(size)])
            counts[chosen] = size
            for k, c in enumerate(chosen):
                out[c] = flat[edge[k] : edge[k + 1]]
            row = stop
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(counts)])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, joined, and the offset of each text with the total last."""
        data, start, first = pieces(texts)
        end = np.append(start[1:], len(data)) if len(start) else start
        keys = span(prefix(_BYTE_HASH[data]), start, end) ^ (end - start).astype(U)
        place = self.known.find(keys)
        new = np.flatnonzero(place < 0)
        ids, begins = self.known_ids, self.known_start
        if len(new):
            unique, one, which = np.unique(keys[new], return_index=True, return_inverse=True)
            more, edge = self._encode_pieces(data, start[new[one]], end[new[one]])
            place[new] = len(begins) - 1 + which
            ids, begins = np.concatenate([ids, more]), np.concatenate([begins, edge[1:] + begins[-1]])
            if len(self.known.keys) < CACHE:  # then it stays as it is
                self.known_ids, self.known_start = ids, begins
                self.known = HashTable(np.concatenate([self.known.keys, unique]))
        begin = begins[place]
        count = begins[place + 1] - begin
        total = np.concatenate([[0], np.cumsum(count)])
        gather = np.arange(total[-1]) + np.repeat(begin - total[:-1], count)
        return ids[gather], total[first]

    def decode(self, ids: np.ndarray, edge: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of all texts, joined, and the offset of each."""
        length = self.length[ids]
        total = np.concatenate([[0], np.cumsum(length)])
        gather = np.arange(total[-1]) + np.repeat(self.offset[ids] - total[:-1], length)
        return self.bytes[gather].tobytes(), total[edge]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """SCHEMA for every row: its tokens, and whether decoding them gave the text's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for row, texts in blocks(column):
                tokens, edge = c.encode(texts)
                back, place = c.decode(tokens, edge)
                equal = [back[place[k] : place[k + 1]] == t for k, t in enumerate(texts)]
                null = column.slice(row, len(texts)).is_null().to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32), mask=np.append(null, False)), pa.array(tokens))
                yield pa.record_batch(
                    [ids.slice(row, len(texts)), lists, pa.array(np.diff(edge).astype(np.int32), mask=null), pa.array(np.array(equal, bool), mask=null)],
                    ["doc_id", "tokens", "n_tokens", "decoded_equal"],
                )

    return docs.select(id_column(docs), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, tokens); null tokens give null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            column = batch.column(1)
            null = column.is_null().to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.where(null, 0, np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64))
            back, place = c.decode(flat, np.concatenate([[0], np.cumsum(size)]))
            texts = [None if null[k] else back[place[k] : place[k + 1]].decode("utf-8", "replace") for k in range(len(column))]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(id_column(tokens), "tokens").mapInArrow(run, "doc_id long, text string")
