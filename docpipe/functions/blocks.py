"""The block tree that parsers build inside one Python call, and what becomes of it: Markdown,
text, JSON and flat rows.

Spans are tuples: ("text", s) ("code", s) ("br",) ("bold", spans) ("italic", spans)
("link", href, spans). Blocks are tuples: ("heading", level, spans) ("paragraph", spans)
("list", ordered, items) ("table", header or None, rows) ("code", lang or None, text)
("image", alt or None) ("page_break", page); items are lists of blocks, rows lists of cells,
cells lists of spans. Recursion stays in here; DataFrames get rows with a parent column and
spans as a flat token stream whose brackets balance.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from .text import WS, py_escape_href, py_escape_leading, py_escape_markdown, py_longest_backticks, py_one_line


def text(s: str) -> list[tuple]:
    """A run of plain text; nothing for the empty string."""
    return [("text", s)] if s else []


def styled(spans: list[tuple], bold: bool, italic: bool) -> list[tuple]:
    if italic:
        spans = [("italic", spans)]
    return [("bold", spans)] if bold else spans


def spans_plain(spans: Iterable[tuple]) -> str:
    out: list[str] = []
    for s in spans:
        if s[0] == "br":
            out.append("\n")
        elif s[0] in ("text", "code"):
            out.append(s[1])
        else:
            out.append(spans_plain(s[-1]))
    return "".join(out)


def plain(block: tuple) -> str:
    kind = block[0]
    if kind in ("heading", "paragraph"):
        return spans_plain(block[-1])
    if kind == "list":
        return "\n".join(plain(b) for item in block[2] for b in item)
    if kind == "table":
        return "\n".join(_tabbed(r) for r in ([block[1]] if block[1] is not None else []) + block[2])
    if kind == "code":
        return block[2]
    return (block[1] or "") if kind == "image" else ""


def _tabbed(row: list) -> str:
    return "\t".join(map(spans_plain, row))


def spans_md(spans: Iterable[tuple]) -> str:
    out: list[str] = []
    for s in spans:
        kind = s[0]
        if kind == "text":
            out.append(py_escape_markdown(s[1]))
        elif kind == "br":
            out.append("  \n")
        elif kind == "code":
            fence = "`" * (py_longest_backticks(s[1]) + 1)
            pad = " " if s[1][:1] == "`" or s[1][-1:] == "`" else ""
            out.append(fence + pad + s[1] + pad + fence)
        elif kind == "link":
            label = spans_md(s[2]).strip(WS) or py_escape_markdown(s[1]).strip(WS)
            out.append(f"[{label}]({py_escape_href(s[1])})")
        elif inner := spans_md(s[1]).strip(WS):
            mark = "**" if kind == "bold" else "*"
            out.append(mark + inner + mark)
    return "".join(out)


def _hang(marker: str, body: str) -> str:
    """The first line behind the marker, the others below it."""
    lines = [line.removesuffix("\r") for line in body.split("\n")]
    pad = " " * len(marker)
    return "".join((marker if k == 0 else pad if line else "") + line + "\n" for k, line in enumerate(lines))


def _markers(ordered: bool, n: int) -> list[str]:
    return [f"{k + 1}. " if ordered else "- " for k in range(n)]


def _table_md(header: list | None, rows: list) -> str:
    every = [header or [], *rows]
    width = max(map(len, every))
    if not width:
        return ""
    cells = [[py_one_line(spans_md(c)).replace("|", "\\|") for c in r] + [""] * (width - len(r)) for r in every]
    size = [max(3, *(len(r[k]) for r in cells)) for k in range(width)]
    cells.insert(1, ["-" * n for n in size])
    return "\n".join("| " + " | ".join(c.ljust(n) for c, n in zip(r, size)) + " |" for r in cells)


def md(block: tuple) -> str:
    kind = block[0]
    if kind == "heading":
        return "#" * min(6, max(1, block[1])) + " " + py_one_line(spans_md(block[2]))
    if kind == "paragraph":
        return py_escape_leading(spans_md(block[1]))
    if kind == "list":
        out = []
        for marker, item in zip(_markers(block[1], len(block[2])), block[2]):
            body = ""
            for k, b in enumerate(item):
                if (one := md(b).rstrip(WS)).strip(WS):
                    tight = b[0] == "paragraph" and k + 1 < len(item) and item[k + 1][0] == "list"
                    body += one + ("\n" if tight else "\n\n")
            body = body.rstrip(WS)
            out.append(_hang(marker, body) if body else marker.rstrip() + "\n")
        return "".join(out)
    if kind == "table":
        return _table_md(block[1], block[2])
    if kind == "code":
        fence = "`" * (max(py_longest_backticks(block[2]), 2) + 1)
        return f"{fence}{block[1] or ''}\n{block[2].rstrip(WS)}\n{fence}"
    if kind == "image":
        alt = (block[1] or "").strip(WS)
        return f"![{py_escape_markdown(alt)}]()" if alt else ""
    return f"<!-- page {block[1]} -->"


def txt(block: tuple) -> str:
    kind = block[0]
    if kind == "heading":
        return py_one_line(spans_plain(block[2]))
    if kind == "list":
        bodies = ["\n\n".join(t for t in (txt(b).rstrip(WS) for b in item) if t.strip(WS)) for item in block[2]]
        return "".join(_hang(m, b) for m, b in zip(_markers(block[1], len(bodies)), bodies) if b)
    if kind == "code":
        return block[2].rstrip(WS)
    return plain(block)


def _spans_json(spans: list[tuple]) -> list[dict]:
    out = []
    for s in spans:
        if s[0] == "br":
            out.append({"type": "line_break"})
        elif s[0] == "link":
            out.append({"type": "link", "value": {"href": s[1], "text": _spans_json(s[2])}})
        else:
            out.append({"type": s[0], "value": s[1] if isinstance(s[1], str) else _spans_json(s[1])})
    return out


def to_json(block: tuple) -> dict:
    kind = block[0]
    out: dict = {"type": kind}
    if kind == "heading":
        out |= {"level": block[1], "text": _spans_json(block[2])}
    elif kind == "paragraph":
        out["text"] = _spans_json(block[1])
    elif kind == "list":
        out |= {"ordered": block[1], "items": [[to_json(b) for b in item] for item in block[2]]}
    elif kind == "table":
        row = lambda r: {"cells": [_spans_json(c) for c in r]}
        out |= {"header": None if block[1] is None else row(block[1]), "rows": [row(r) for r in block[2]]}
    elif kind == "code":
        out |= {"lang": block[1], "text": block[2]}
    elif kind == "image":
        out["alt"] = block[1]
    else:
        out["page"] = block[1]
    return out


def _spans_from(found: list[dict]) -> list[tuple]:
    out: list[tuple] = []
    for s in found:
        kind, value = s["type"], s.get("value")
        if kind == "line_break":
            out.append(("br",))
        elif kind == "link":
            out.append(("link", value["href"], _spans_from(value["text"])))
        else:
            out.append((kind, value if isinstance(value, str) else _spans_from(value)))
    return out


def from_json(b: dict) -> tuple:
    """The inverse of to_json."""
    kind = b["type"]
    if kind == "heading":
        return kind, b["level"], _spans_from(b["text"])
    if kind == "paragraph":
        return kind, _spans_from(b["text"])
    if kind == "list":
        return kind, b["ordered"], [[from_json(x) for x in item] for item in b["items"]]
    if kind == "table":
        cells = lambda r: [_spans_from(c) for c in r["cells"]]
        return kind, b["header"] and cells(b["header"]), [cells(r) for r in b["rows"]]
    return (kind, b["lang"], b["text"]) if kind == "code" else (kind, b["alt" if kind == "image" else "page"])


def tokens(spans: list[tuple]) -> list[dict]:
    """The balanced token stream: a styled run is op, its content, and |op."""
    out: list[dict] = []
    for s in spans:
        if s[0] in ("text", "code"):
            out.append({"op": s[0], "value": s[1], "href": None})
        elif s[0] == "br":
            out.append({"op": "br", "value": None, "href": None})
        else:
            out.append({"op": s[0], "value": None, "href": s[1] if s[0] == "link" else None})
            out += tokens(s[-1])
            out.append({"op": "|" + s[0], "value": None, "href": None})
    return out


def spans_of(stream: list[dict]) -> list[tuple]:
    """The inverse of tokens()."""
    stack: list[tuple[str, str | None, list]] = [("", None, [])]
    for t in stream:
        op = t["op"]
        if op in ("text", "code"):
            stack[-1][2].append((op, t["value"]))
        elif op == "br":
            stack[-1][2].append(("br",))
        elif op.startswith("|"):
            kind, href, inner = stack.pop()
            stack[-1][2].append((kind, href, inner) if kind == "link" else (kind, inner))
        else:
            stack.append((op, t["href"], []))
    return stack[0][2]


def is_blank(blocks: list[tuple]) -> bool:
    """Whether no block holds text; page marks don't count, alternative texts do."""
    return all(not plain(b).strip(WS) for b in blocks)


_SLIM = {
    "type": lambda b: b[0], "level": lambda b: b[1] if b[0] == "heading" else None, "plain": plain, "md": md, "txt": txt,
    "json": lambda b: json.dumps(to_json(b), ensure_ascii=False, sort_keys=True, separators=(",", ":")),
}


def slim(blocks: list[tuple], fields: Iterable[str] = tuple(_SLIM)) -> list[dict]:
    """A row for each top-level block with all that rendering and chunking need, or the fields of it."""
    makers = [(k, _SLIM[k]) for k in fields]
    return [{k: f(b) for k, f in makers} for b in blocks]


_FULL = _SLIM | {
    "ordered": lambda b: b[1] if b[0] == "list" else None, "lang": lambda b: b[1] if b[0] == "code" else None, "page": lambda b: b[1] if b[0] == "page_break" else None,
    "code": lambda b: b[2] if b[0] == "code" else None, "alt": lambda b: b[1] if b[0] == "image" else None,
    "spans": lambda b: tokens(b[-1]) if b[0] in ("heading", "paragraph") else None,
    "header": lambda b: [tokens(c) for c in b[1]] if b[0] == "table" and b[1] is not None else None,
    "rows": lambda b: [[tokens(c) for c in r] for r in b[2]] if b[0] == "table" else None,
}
_PLACE = ("block_idx", "parent_idx", "item_no", "depth")
_ROW = (*_PLACE, "type", "level", "ordered", "lang", "page", "code", "alt", "spans", "header", "rows", "plain", "md", "txt")


def flat(blocks: list[tuple], fields: Iterable[str] = _ROW) -> list[dict]:
    """A row for every block in pre-order, or the fields of it; children of lists name their parent and item."""
    rows: list[dict] = []
    makers = [(k, _FULL[k]) for k in fields if k not in _PLACE]
    places = [(k, _PLACE.index(k)) for k in fields if k in _PLACE]

    def add(b: tuple, parent: int | None, item: int | None, depth: int) -> None:
        own = len(rows)
        place = (own, parent, item, depth)
        rows.append({k: place[i] for k, i in places} | {k: f(b) for k, f in makers})
        if b[0] == "list":
            for k, inner in enumerate(b[2]):
                for x in inner:
                    add(x, own, k, depth + 1)

    for b in blocks:
        add(b, None, None, 0)
    return rows


_EDGE = re.compile(f"^[{WS}]+")


def trim_spans(spans: list[tuple]) -> list[tuple]:
    """Without white space at both ends, and without line breaks at the end. Only the outer
    level is trimmed."""
    spans = list(spans)
    while spans and spans[0][0] == "text":
        left = _EDGE.sub("", spans[0][1])
        if left:
            spans[0] = ("text", left)
            break
        del spans[0]
    while spans:
        if spans[-1][0] == "text":
            left = spans[-1][1].rstrip(WS)
            if left:
                spans[-1] = ("text", left)
                break
        elif spans[-1][0] != "br":
            break
        spans.pop()
    return spans
