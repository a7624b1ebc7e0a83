"""Vectorised text kernels: Arrow string columns in, numpy arrays out.

A word is a maximal run of ASCII letters, digits and non-ASCII bytes; letters are folded
for ASCII and Latin-1 only, so byte positions stay those of the original text. Hashes are
64-bit polynomials over the bytes, read off prefix sums (the base is odd, hence invertible
modulo 2**64), so a hash of any span costs two gathers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BLOCK = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = bytes(int(chr(b).isalnum() and b < 128 or b >= 128) for b in range(256))
_NOT_SPACE = bytes(int(b not in b" \t\n\r\x0b\x0c") for b in range(256))
_BYTE_HASH = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for k, base in enumerate((BASE, BASE_INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that lets every bit depend on every other."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which span() reads hashes."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values))[0], dtype=U, out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], the same wherever the span lies."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def windows(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive values."""
    count = len(values) - n + 1
    if count <= 0:
        return np.zeros(0, U)
    sums = prefix(values)
    return mix((sums[n:] - sums[:count]) * powers(count)[1])


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) in pieces of about `limit` bytes; null is empty text."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    row = 0
    while row < len(column):
        done = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield row, column.slice(row, stop - row).to_pylist()
        row = stop


class Words:
    """Words of some texts. start, end: bytes in `data`; doc: text of each word; first:
    first word of each text, and the count; base: where each text starts in `data`."""

    def __init__(self, texts: list[bytes], space: bool = False, fold: bool = True):
        joined = b"\n".join(texts) + b"\n"
        if fold:
            joined = joined.translate(_LOWER)
        self.data = np.frombuffer(joined, np.uint8)
        if fold and b"\xc3" in joined:
            follows = np.flatnonzero(self.data == 0xC3) + 1
            byte = self.data[follows]
            self.data = self.data.copy()
            self.data[follows[(byte >= 0x80) & (byte <= 0x9E) & (byte != 0x97)]] += 0x20
        inside = np.frombuffer(joined.translate(_NOT_SPACE if space else _WORD), np.int8)
        edge = np.flatnonzero(np.diff(inside, prepend=np.int8(0)))
        self.start, self.end = edge[::2], edge[1::2]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.base = np.concatenate([[0], np.cumsum(size + 1)])
        self.first = np.searchsorted(self.start, self.base)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        sums = prefix(_BYTE_HASH[self.data])
        return span(sums, self.start, self.end)


def ngrams(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and texts of the n-grams that lie within a text; a text of 1 to n-1 words
    gives one, of all its words."""
    grams = windows(hashes, n)
    inside = words.doc[: len(grams)] == words.doc[n - 1 :] if len(grams) else np.zeros(0, bool)
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < n))
    sums = prefix(hashes)
    return (
        np.concatenate([grams[inside], span(sums, words.first[short], words.first[short + 1])]),
        np.concatenate([words.doc[: len(grams)][inside], short]),
    )


class HashTable:
    """Open addressing from 64-bit keys to their places in `keys`, all lookups at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys = keys.astype(U)
        self.slot = np.full(1 << self.bits, -1, np.int32 if len(keys) < 1 << 31 else np.int64)
        self.longest = 0
        left = np.arange(len(keys))
        at = self._home(self.keys)
        while len(left):
            self.longest += 1
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0xD6E8FEB86659FD93)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys) or not len(keys):
            return out
        at, left = self._home(keys), None
        for _ in range(self.longest):
            place = self.slot[at]
            asked = keys if left is None else keys[left]
            hit = place >= 0
            hit &= self.keys[place] == asked
            more = (place >= 0) & ~hit
            if left is None:
                out[hit] = place[hit]
                left = np.flatnonzero(more)
            else:
                out[left[hit]] = place[hit]
                left = left[more]
            if not len(left):
                break
            at = (at[more] + 1) & ((1 << self.bits) - 1)
        return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
