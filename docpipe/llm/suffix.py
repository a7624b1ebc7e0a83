"""External suffix and common-prefix arrays by induced sorting.

After Bingmann, Fischer and Osipov, "Inducing Suffix and LCP Arrays in External Memory"
(2013). Text, suffix array and common-prefix array are files; queues on disk carry suffix
tuples (position, common prefix with the tuple before) from the place where a suffix is
scanned to the place where its left neighbour belongs. Tuples reach each symbol's queue in
order of rank, so the priority queue is one disk-backed queue for each symbol. The suffixes
that start the induction are named and sorted by recursion; when the recursive string fits
in memory it is sorted there by prefix doubling.

All steps are numpy operations on whole batches: one batch is what waits for one symbol.
Symbols must be few for that, so callers and the recursion write a large alphabet as two
digits; a digit's string has the same order at even positions.

depth: suffixes are told apart, and common prefixes counted, up to that many symbols.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np


PREFIX_BITS = 20  # a tuple is one integer: position, then common prefix


class Scratch:
    """Files of one sort, in a folder of its own that goes with it."""

    def __init__(self, root: str | None, memory: int = 1 << 22):
        self.path = tempfile.mkdtemp(prefix="suffixes", dir=root)
        self.memory, self.count = memory, 0

    def array(self, n: int, dtype) -> np.memmap | np.ndarray:
        if n == 0:
            return np.zeros(0, dtype)
        self.count += 1
        return np.memmap(f"{self.path}/{self.count}", dtype, "w+", shape=(int(n),))

    def file(self) -> str:
        self.count += 1
        return f"{self.path}/{self.count}"

    def drop(self, array: np.ndarray) -> None:
        if isinstance(array, np.memmap) and array.filename and os.path.exists(array.filename):
            os.unlink(array.filename)

    def close(self) -> None:
        shutil.rmtree(self.path, ignore_errors=True)


class Queues:
    """A queue of (position, prefix) for each symbol; beyond a multiple of `memory` tuples all go
    to disk. Each spill is a file of its own, which goes when its last tuples are popped."""

    def __init__(self, n: int, scratch: Scratch):
        self.limit, self.held, self.scratch = 2 * scratch.memory, 0, scratch
        self.parts: list[list] = [[] for _ in range(n)]
        self.left: dict[str, int] = {}

    def push(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.parts[symbol].append(at << PREFIX_BITS | lcp)
        self.held += len(at)
        if self.held > self.limit:
            self.spill()

    def spill(self) -> None:
        name, n = self.scratch.file(), 0
        with open(name, "wb") as file:
            for waiting in self.parts:
                for k, x in enumerate(waiting):
                    if isinstance(x, np.ndarray):
                        waiting[k] = (name, file.tell(), len(x))
                        file.write(x)
                        n += 1
        self.left[name] = n
        self.held = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        waiting, self.parts[symbol] = self.parts[symbol], []
        if not waiting:
            return None
        for k, x in enumerate(waiting):
            if isinstance(x, tuple):
                name, at, n = x
                waiting[k] = np.fromfile(name, np.int64, n, offset=at)
                self.left[name] -= 1
                if not self.left[name]:
                    os.unlink(name)
                    del self.left[name]
            else:
                self.held -= len(x)
        all_of = waiting[0] if len(waiting) == 1 else np.concatenate(waiting)
        return all_of >> PREFIX_BITS, (all_of & ((1 << PREFIX_BITS) - 1)).astype(np.int32)

    def close(self) -> None:
        for name in self.left:
            os.unlink(name)


class RangeMin:
    """Minima of ranges of a batch (sparse table)."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]
        step = 1
        while 2 * step <= len(x):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """min of x[low:high], low < high."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.levels[0].dtype)
        for k in range(len(self.levels)):
            rows = np.flatnonzero(level == k)
            if len(rows):
                x = self.levels[k]
                out[rows] = np.minimum(x[low[rows]], x[high[rows] - (1 << k)])
        return out


class Pushes:
    """Common prefixes of the tuples that scanning pushes: one more than the least common
    prefix scanned since the last push to the same symbol."""

    def __init__(self, n_symbols: int, depth: int):
        self.since = np.full(n_symbols, -1, np.int64)  # -1: nothing pushed yet
        self.depth = depth

    def send(self, queues: Queues, symbols: np.ndarray, rows: np.ndarray, at: np.ndarray, lcp: np.ndarray) -> None:
        """Of a scanned batch with common prefixes lcp, the rows `rows` push at[...]"""
        lcp = lcp.astype(np.int32)
        m = len(lcp)
        if m and not len(rows):
            np.minimum(self.since, lcp.min(), out=self.since)
            return
        order = np.argsort(symbols, kind="stable")
        symbols, rows, at = symbols[order], rows[order], at[order]
        cut = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
        new = np.empty(len(rows), np.int32)
        follows = np.ones(len(rows), bool)
        follows[cut] = False
        k = np.flatnonzero(follows)
        if len(k):
            new[k] = RangeMin(lcp)(rows[k - 1] + 1, rows[k] + 1) + 1
        upto, after = np.minimum.accumulate(lcp), np.minimum.accumulate(lcp[::-1])[::-1]
        heads = symbols[cut]
        new[cut] = np.minimum(self.since[heads], upto[rows[cut]]) + 1  # -1 + 1: the first has none
        np.minimum(new, self.depth, out=new)
        ends = np.append(cut[1:], len(rows)) - 1
        np.minimum(self.since, lcp.min(), out=self.since)
        last = rows[ends]
        self.since[heads] = np.where(last + 1 < m, after[np.minimum(last + 1, m - 1)], self.depth)
        for s, low, high in zip(heads.tolist(), cut.tolist(), (ends + 1).tolist()):
            queues.push(s, at[low:high], new[low:high])


def _run(text: np.ndarray, at: int, most: int) -> int:
    """Length of the run of equal symbols at `at`, counted up to `most`."""
    part = np.asarray(text[at : at + most])
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def _induce(text: np.ndarray, n_symbols: int, seeds: np.ndarray, seed_lcp: np.ndarray, counts: np.ndarray, sa: np.ndarray, lcp: np.ndarray, depth: int, scratch: Scratch) -> None:
    """Fills sa and lcp (of the text with its sentinel, which is symbol 0 at the end) from
    the seeds, which come by symbol and, within a symbol, in order."""
    starts = np.concatenate([[0], np.cumsum(counts)])
    step = max(1024, scratch.memory)
    of_seed = np.concatenate([[0], np.cumsum(_symbol_counts(text, seeds, n_symbols, step))])
    n_left = np.zeros(n_symbols, np.int64)

    def between(left: int, right: int) -> int:
        return min(_run(text, left, depth), _run(text, right, depth), depth)

    queues, pushes = Queues(n_symbols, scratch), Pushes(n_symbols, depth)

    def scan_left(at: np.ndarray, prefixes: np.ndarray, c: int) -> None:
        for row in range(0, len(at), step):
            own = at[row : row + step]
            rows = np.flatnonzero(own > 0)
            before = own[rows] - 1
            symbols = np.asarray(text[before])
            down = symbols >= c
            pushes.send(queues, symbols[down], rows[down], before[down], prefixes[row : row + step])

    for c in range(n_symbols):
        filled, last = 0, -1
        while (batch := queues.pop(c)) is not None:
            at, prefixes = batch
            here = starts[c] + filled
            sa[here : here + len(at)], lcp[here : here + len(at)] = at, prefixes
            filled, last = filled + len(at), int(at[-1])
            scan_left(at, prefixes, c)
        n_left[c] = filled
        low, high = of_seed[c], of_seed[c + 1]
        if low < high:
            own, prefixes = np.asarray(seeds[low:high]).astype(np.int64), np.array(seed_lcp[low:high]).astype(np.int32)
            prefixes[0] = between(last, int(own[0])) if last >= 0 else 0
            scan_left(own, prefixes, c)
    queues.close()

    queues, pushes = Queues(n_symbols, scratch), Pushes(n_symbols, depth)

    def scan_right(at: np.ndarray, prefixes: np.ndarray, c: int, own_too: bool) -> None:
        for row in range(0, len(at), step):
            own = at[row : row + step]
            rows = np.flatnonzero(own > 0)
            before = own[rows] - 1
            symbols = np.asarray(text[before])
            up = (symbols <= c) if own_too else (symbols < c)
            pushes.send(queues, symbols[up], rows[up], before[up], prefixes[row : row + step])

    for c in range(n_symbols - 1, 0, -1):
        top = starts[c + 1]
        first = -1
        while (batch := queues.pop(c)) is not None:
            at, prefixes = batch
            # prefixes[k] belongs to the pair at[k], at[k-1]; in the array it stands at at[k-1].
            sa[top - len(at) : top] = at[::-1]
            spots = np.arange(top - 1, top - 1 - len(at), -1)
            inner = spots + 1 < starts[c + 1]
            lcp[spots[inner] + 1] = prefixes[inner]
            top, first = top - len(at), int(at[-1])
            scan_right(at, prefixes, c, True)
        n = int(n_left[c])
        if first >= 0:
            lcp[top] = between(int(sa[starts[c] + n - 1]), first) if n else 0
        if n:
            # Scanned downwards: a tuple's prefix is that with the one above it.
            high = starts[c] + n
            after = between(int(sa[high - 1]), first) if first >= 0 else 0
            for upper in range(int(high), int(starts[c]), -step):
                lower = max(int(starts[c]), upper - step)
                at = np.asarray(sa[lower:upper])[::-1].astype(np.int64)
                prefixes = np.append(np.asarray(lcp[lower + 1 : upper]), after)[::-1]
                after = int(lcp[lower])
                scan_right(at, prefixes, c, False)
    queues.close()
    sa[0], lcp[0] = len(text) - 1, 0


def _symbol_counts(text: np.ndarray, at: np.ndarray, n_symbols: int, step: int) -> np.ndarray:
    counts = np.zeros(n_symbols, np.int64)
    for row in range(0, len(at), step):
        counts += np.bincount(text[at[row : row + step]], minlength=n_symbols)
    return counts


def _by_symbol(text: np.ndarray, at: np.ndarray, n_symbols: int, scratch: Scratch) -> np.ndarray:
    """The positions in a file, ordered by their symbol and, within it, as they come."""
    step = max(1024, scratch.memory)
    counts = _symbol_counts(text, at, n_symbols, step)
    upto = np.cumsum(counts) - counts
    out = scratch.array(len(at), _index(len(text)))
    for row in range(0, len(at), step):
        own = np.asarray(at[row : row + step])
        symbols = np.asarray(text[own])
        order = np.argsort(symbols, kind="stable")
        own, symbols = own[order], symbols[order]
        here = np.bincount(symbols, minlength=n_symbols)
        out[upto[symbols] + np.arange(len(own)) - (np.cumsum(here) - here)[symbols]] = own
        upto += here
    return out


def _seed_positions(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Positions of the leftmost of each ascent (the sentinel's is the last), in a file."""
    n = len(text)
    parts: list[tuple[str, int]] = []
    rising = True  # the type of the suffix right of the block
    for high in range(n - 1, 0, -scratch.memory):
        low = max(0, high - scratch.memory)
        part = np.asarray(text[low : high + 1]).astype(np.int64)
        sign = np.sign(np.diff(part))
        k = np.where(sign != 0, np.arange(len(sign)), len(sign))
        k = np.minimum.accumulate(k[::-1])[::-1]
        up = np.append(sign > 0, rising)[k]
        types = np.append(up, rising)  # of low .. high
        found = np.flatnonzero(types[1:] & ~types[:-1]) + low + 1
        name = scratch.file()
        found.astype(np.int64).tofile(name)
        parts.append((name, len(found)))
        rising = bool(types[0])
    out = scratch.array(sum(k for _, k in parts), _index(n))
    at = 0
    for name, k in reversed(parts):
        out[at : at + k] = np.fromfile(name, np.int64)
        os.unlink(name)
        at += k
    return out


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, have: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of the suffixes a and b, of which `have` symbols are known to agree."""
    out = np.minimum(have, depth).astype(np.int32)
    n = len(text)
    left = np.flatnonzero(out < depth)
    while len(left):
        x, y = a[left] + out[left], b[left] + out[left]
        same = (x < n) & (y < n)
        same[same] = np.asarray(text[x[same]]) == np.asarray(text[y[same]])
        left = left[same]
        out[left] += 1
        left = left[out[left] < depth]
    return out


def _double(names: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """In memory: order of the suffixes of names (small integers from 1), told apart up to
    `depth` names, and their common prefixes in names."""
    n = len(names)
    rank = names.astype(np.int64)
    k = 1
    order = np.argsort(rank, kind="stable")
    while True:
        new = np.append(True, rank[order][1:] != rank[order][:-1])
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(new)
        rank = dense
        if k >= depth or new.all():
            break
        # Only what is still tied is sorted again, in place of its ties.
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, n))
        tied = np.flatnonzero(np.repeat(size, size) > 1)
        own = order[tied]
        follow = np.where(own + k < n, rank[np.minimum(own + k, n - 1)], 0)
        key = rank[own] * (n + 1) + follow
        order[tied] = own[np.argsort(key, kind="stable")]
        rank = rank * (n + 1)
        rank += np.where(np.arange(n) + k < n, dense[np.minimum(np.arange(n) + k, n - 1)], 0)
        k *= 2
    return order, _common(names, order[1:], order[:-1], np.zeros(max(0, n - 1), np.int32), depth)


def _index(n: int) -> type:
    """The type of positions in n symbols."""
    return np.int32 if n < 1 << 31 else np.int64


def suffix_array(text: np.ndarray, n_symbols: int, depth: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common prefixes (with the suffix before) of text, whose last symbol
    is 0 and whose others lie in 1 .. n_symbols-1; the sentinel's suffix comes first."""
    n = len(text)
    index, short = _index(n), np.int16 if depth < 1 << 15 else np.int32
    sa, lcp = scratch.array(n, index), scratch.array(n, short)
    counts = np.zeros(n_symbols, np.int64)
    for row in range(0, n, scratch.memory):
        counts += np.bincount(text[row : row + scratch.memory], minlength=n_symbols)
    places = _seed_positions(text, scratch)
    m = len(places)
    step = max(1024, scratch.memory)
    places_sorted, prefix = places, scratch.array(m, short)
    if m > 1:
        # Sort the seeds' substrings (to the next seed) by one induction, then name them.
        seeds = _by_symbol(text, places, n_symbols, scratch)
        _induce(text, n_symbols, seeds, prefix, counts, sa, lcp, 1, scratch)
        filled = 0
        for row in range(0, n, step):
            part = np.asarray(sa[row : row + step]).astype(np.int64)
            k = np.minimum(np.searchsorted(places, part), m - 1)
            k = k[places[k] == part]
            seeds[filled : filled + len(k)] = k
            filled += len(k)
        names, last = scratch.array(m, index), 0
        for row in range(0, m, step):
            own = np.asarray(seeds[max(0, row - 1) : row + step]).astype(np.int64)
            at = places[own].astype(np.int64)
            size = places[np.minimum(own + 1, m - 1)] - at + 1
            new = np.ones(len(own), bool)
            same = np.flatnonzero(size[1:] == size[:-1]) + 1
            new[same] = ~_equal(text, at[same], at[same - 1], size[same])
            skip = int(row > 0)  # the one before the block is there to compare with only
            named = np.cumsum(new[skip:]) + last
            names[own[skip:]] = named
            last = int(named[-1])
        if last < m:
            # What is not needed below gives its room to the recursion.
            for x in (sa, lcp, seeds):
                scratch.drop(x)
            del sa, lcp, seeds
            if m <= scratch.memory:
                order, agree = _double(np.asarray(names), depth)
                agree = np.append(0, agree).astype(np.int64)
            else:
                digits = int(np.sqrt(last)) + 1
                small = scratch.array(2 * m + 1, np.int32)
                for row in range(0, m, step):
                    own = np.asarray(names[row : row + step]).astype(np.int64)
                    small[2 * row : 2 * (row + len(own)) : 2] = own // digits + 1
                    small[2 * row + 1 : 2 * (row + len(own)) : 2] = own % digits + 1
                small[2 * m] = 0
                scratch.drop(names)
                names = None  # a file's room is free once it is mapped no more
                inner, prefixes = suffix_array(small, digits + 2, 2 * depth, scratch)
                scratch.drop(small)
                small = None
                order, agree = evens(inner, prefixes, scratch)
                for x in (inner, prefixes):
                    scratch.drop(x)
                del inner, prefixes
            sa, lcp = scratch.array(n, index), scratch.array(n, short)
        else:
            order, agree = seeds, None
        # Names that agree cover the text from one seed to another; compare on from there.
        # The last name covers nothing: the sentinel is the seed that it names.
        places_sorted = scratch.array(m, index)
        for row in range(0, m, step):
            own = np.asarray(order[max(0, row - 1) : row + step]).astype(np.int64)
            at = places[own].astype(np.int64)
            places_sorted[max(0, row - 1) : row + step] = at
            have = np.zeros(len(own), np.int64)
            if agree is not None:
                have = places[np.minimum(own + agree[max(0, row - 1) : row + step], m - 1)] - at
            prefix[max(1, row) : row + step] = _common(text, at[1:], at[:-1], have[1:], depth)
        prefix[0] = 0
        for x in (names, order, agree):
            scratch.drop(x)
        del names, order, agree
    _induce(text, n_symbols, places_sorted, prefix, counts, sa, lcp, depth, scratch)
    for x in {id(x): x for x in (places, places_sorted, prefix)}.values():
        scratch.drop(x)
    return sa, lcp


def _equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether text[a:a+size] is text[b:b+size]."""
    out = np.ones(len(a), bool)
    left, k = np.arange(len(a)), 0
    while len(left):
        same = np.asarray(text[a[left] + k]) == np.asarray(text[b[left] + k])
        out[left[~same]] = False
        k += 1
        left = left[same]
        left = left[size[left] > k]
    return out


def evens(sa: np.ndarray, lcp: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Halves of the even positions of a suffix array, without the sentinel, and of their common
    prefixes, in files."""
    n = len(sa) // 2
    order, agree = scratch.array(n, _index(n)), scratch.array(n, np.int32)
    filled, least = 0, np.iinfo(np.int32).max  # the least prefix since the last kept suffix
    for row in range(0, len(sa), max(1024, scratch.memory)):
        part, own = np.asarray(sa[row : row + max(1024, scratch.memory)]).astype(np.int64), np.array(lcp[row : row + max(1024, scratch.memory)])
        keep = np.flatnonzero((part % 2 == 0) & (part < len(sa) - 1))
        if not len(keep):
            least = min(least, int(own.min()))
            continue
        first = np.minimum.reduceat(own, np.append(0, keep[:-1] + 1))
        first[-1] = own[(keep[-2] + 1 if len(keep) > 1 else 0) : keep[-1] + 1].min()
        first[0] = min(first[0], least)
        rest = own[keep[-1] + 1 :]
        least = int(rest.min()) if len(rest) else np.iinfo(np.int32).max
        order[filled : filled + len(keep)], agree[filled : filled + len(keep)] = part[keep] // 2, first // 2
        filled += len(keep)
    return order, agree
