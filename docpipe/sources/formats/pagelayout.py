"""Glyphs of a page to blocks: cut into bands and columns, cluster into lines, break into
paragraphs, and call what is set larger a heading. `operators/layout.py` has the same steps as
window functions over a table of glyphs; this is the form that runs within the parsing task."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from itertools import groupby
from operator import itemgetter

from ...functions.blocks import text
from ...functions.text import WS

Glyph = tuple[float, float, float, float, str]
MAX_CUTS, MIN_GLYPHS = 6, 40


def upper_median(sizes: list[float]) -> float:
    return sorted(sizes)[len(sizes) // 2] if sizes else 0.0


def _bands(glyphs: list[Glyph], body: float) -> list[list[Glyph]] | None:
    """Glyphs are sorted by y."""
    ys = list(map(itemgetter(1), glyphs))
    kept: list[float] = []
    for y in dict.fromkeys(ys):
        if not kept or abs(y - kept[-1]) >= body * 0.5:
            kept.append(y)
    cut = next(((a + b) / 2 for a, b in zip(kept, kept[1:]) if b - a > body * 2.5), None)
    if cut is None:
        return None
    k = bisect_left(ys, cut)
    return [glyphs[:k], glyphs[k:]] if 0 < k < len(glyphs) else None


def column_bounds(spans: list[tuple[float, float]], body: float) -> list[tuple[float, float]]:
    """Spans merged where they overlap, then across all gaps narrower than a gutter."""
    if not spans:
        return []
    spans = sorted(spans, key=itemgetter(0))
    low, high = spans[0]
    joined: list[tuple[float, float]] = []
    for a, b in spans:
        if a > high:
            joined.append((low, high))
            low, high = a, b
        elif b > high:
            high = b
    joined.append((low, high))
    gutter = max((high - joined[0][0]) * 0.04, body * 2.0)
    out = joined[:1]
    for a, b in joined[1:]:
        if a - out[-1][1] < gutter:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _columns(glyphs: list[Glyph], body: float) -> list[list[Glyph]] | None:
    bounds = column_bounds(list(map(itemgetter(0, 3), glyphs)), body)
    if len(bounds) < 2:
        return None
    starts = [a for a, _ in bounds]
    out: list[list[Glyph]] = [[] for _ in bounds]
    for g in glyphs:
        k = bisect_right(starts, g[0]) - 1
        out[k if k >= 0 and g[0] <= bounds[k][1] else 0].append(g)
    return out if all(len(c) >= max(len(glyphs) // 10, 20) for c in out) else None


def regions(glyphs: list[Glyph], body: float, depth: int = 0) -> list[list[Glyph]]:
    if depth >= MAX_CUTS or len(glyphs) < MIN_GLYPHS:
        return [glyphs]
    if depth == 0:
        glyphs = sorted(glyphs, key=itemgetter(1))
    parts = _bands(glyphs, body) or _columns(glyphs, body)
    return [r for p in parts for r in regions(p, body, depth + 1)] if parts else [glyphs]


def lines(glyphs: list[Glyph]) -> list[tuple[str, float, float, float, float]]:
    """(text, x, right, y, size) of the lines, from the top."""
    rows: list[list[Glyph]] = []
    for y, same in groupby(sorted(glyphs, key=itemgetter(1, 0)), itemgetter(1)):
        same = list(same)
        if rows and abs(y - rows[-1][-1][1]) <= max(rows[-1][-1][2], same[0][2]) * 0.5:
            rows[-1] += same
        else:
            rows.append(same)
    out = []
    for row in rows:
        row.sort(key=itemgetter(0))
        first = row[0]
        said, end, right, big = [], math.inf, max(map(itemgetter(3), row)), max(1.0, max(map(itemgetter(2), row)))
        for x, _, size, stop, chars in row:
            if x > end + size * 0.2 and said[-1][-1:] != " " and chars[:1] != " ":
                said.append(" ")
            said.append(chars)
            end = stop
        if joined := "".join(said).strip(WS):
            out.append((joined, first[0], right, first[1], big))
    return out


def body_size(rows: list[tuple]) -> float:
    """The size, to half a point, of most characters; of equals the one that came up last."""
    counts: dict[float, int] = {}
    for said, _, _, _, size in rows:
        key = int(size * 2 + 0.5) / 2
        counts[key] = counts.get(key, 0) + len(said)
    return max(reversed(counts), key=counts.__getitem__) if counts else 0.0


def level(size: float, body: float, n_lines: int, said: str) -> int | None:
    if body <= 0 or n_lines > 2 or len(said) > 120:
        return None
    ratio = size / body
    return next((k for k, least in ((1, 1.7), (2, 1.35), (3, 1.15)) if ratio >= least), None)


def _block(rows: list[tuple], body: float) -> tuple:
    said = ""
    for row in rows:
        if said.endswith("-") and said[-2:-1].isalpha() and row[0][:1].islower():
            said = said[:-1] + row[0]
        else:
            said = f"{said} {row[0]}" if said else row[0]
    found = level(max(r[4] for r in rows), body, len(rows), said)
    return ("paragraph", text(said)) if found is None else ("heading", found, text(said))


def paragraphs(rows: list[tuple], body: float) -> list[tuple]:
    edge = max(r[2] for r in rows)
    out: list[list[tuple]] = []
    for row in rows:
        if out:
            _, _, right, y, size = out[-1][-1]
            if not (row[3] - y > size * 1.8 or right < edge - size * 2.0 or abs(row[4] - size) > size * 0.2):
                out[-1].append(row)
                continue
        out.append([row])
    return [_block(p, body) for p in out]


def page_blocks(glyphs: list[Glyph]) -> list[tuple]:
    found = [r for r in map(lines, regions(glyphs, upper_median([g[2] for g in glyphs]))) if r]
    body = body_size([x for r in found for x in r])
    return [b for r in found for b in paragraphs(r, body)]


def blocks(pages: list[tuple[int, list[Glyph]]]) -> list[tuple]:
    """All pages, each but the first behind a page mark."""
    out: list[tuple] = []
    for k, (number, glyphs) in enumerate(pages):
        out += ([("page_break", number)] if k else []) + page_blocks(glyphs)
    return out
