"""Plain text, comma-separated values and Rich Text Format to blocks."""

from __future__ import annotations

import csv
import io
import re

from ...functions.blocks import spans_plain, styled, text
from ...functions.text import WS


def parse_text(source: str) -> list[tuple]:
    """Paragraphs stand between empty lines. Line ends are unified after the split, so a text
    with CRLF throughout is one paragraph."""
    parts = (p.strip(WS) for p in source.split("\n\n"))
    return [("paragraph", text(p.replace("\r\n", "\n"))) for p in parts if p]


def parse_csv(raw: bytes) -> list[tuple]:
    """One table whose first record is the header; records may differ in length. Bytes that
    aren't UTF-8 are an error. Empty lines aren't records."""
    source = raw.decode("utf-8").removeprefix("﻿")
    limit = csv.field_size_limit(max(len(source), 1 << 17))
    try:
        records = [r for r in csv.reader(io.StringIO(source, newline=""), strict=False) if r]
    finally:
        csv.field_size_limit(limit)
    rows = [[text(c) for c in r] for r in records]
    return [("table", rows[0], rows[1:])] if rows else []


SKIPPED = frozenset("colortbl creatim datastore filetbl fldinst fonttbl generator info latentstyles listoverridetable listtable object pict revtbl rsidtbl stylesheet themedata upr xmlnstbl".split())
SIGNS = {"cell": "\t", "tab": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}
_RTF = re.compile(r"([{}])|\\([a-zA-Z]+)(-?[0-9]*) ?|\\'(.{0,2})|\\([^a-zA-Z'])|[\r\n]+|([^\\{}\r\n]+)|\\", re.S)


def _byte(b: int) -> str:
    """Windows-1252; its five holes are the control characters of the same number."""
    return chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252")


class _Rtf:
    def __init__(self):
        self.stack = [{"bold": False, "italic": False, "skip": False, "field": None, "fallback": 1}]
        self.run: list[str] = []
        self.spans: list[tuple] = []
        self.blocks: list[tuple] = []
        self.fields: dict[str, str] = {}
        self.created: dict[str, int] = {}
        self.pending = 0

    def flush(self) -> None:
        run, self.run = "".join(self.run), []
        state = self.stack[-1]
        if run and state["field"] is None:
            self.spans += styled([("text", run)], state["bold"], state["italic"])

    def paragraph(self) -> None:
        self.flush()
        spans, self.spans = self.spans, []
        if spans_plain(spans).strip(WS):
            self.blocks.append(("paragraph", spans))

    def emit(self, chars: str) -> None:
        swallowed = min(self.pending, len(chars))
        self.pending -= swallowed
        chars = chars[swallowed:]
        state = self.stack[-1]
        if not chars:
            return
        if state["field"] is not None:
            self.fields[state["field"]] = self.fields.get(state["field"], "") + chars
        elif not state["skip"]:
            self.run.append(chars)

    def word(self, word: str, number: str) -> None:
        state = self.stack[-1]
        value = int(number) if number.strip("-") else None
        if value is not None and not -(1 << 31) <= value < 1 << 31:
            value = None
        if word in ("par", "sect", "row"):
            self.paragraph()
        elif word == "line":
            self.flush()
            self.spans.append(("br",))
        elif word in SIGNS:
            self.emit(SIGNS[word])
        elif word in ("b", "i"):
            self.flush()
            state["bold" if word == "b" else "italic"] = value != 0
        elif word == "plain":
            self.flush()
            state["bold"] = state["italic"] = False
        elif word == "uc":
            if value is not None:
                state["fallback"] = max(0, value)
        elif word == "u":
            if value is not None:
                code = value + 65536 if value < 0 else value
                if 0 <= code < 0x110000 and not 0xD800 <= code < 0xE000:
                    self.emit(chr(code))
            self.pending = state["fallback"]
        elif word in ("title", "author"):
            self.flush()
            state["field"], state["skip"] = word, False
        elif word in ("yr", "mo", "dy"):
            if value is not None:
                self.created[word] = value
        elif word in SKIPPED:
            state["skip"] = True

    def symbol(self, sign: str) -> None:
        if sign in "\\{}":
            self.emit(sign)
        elif sign == "*":
            self.stack[-1]["skip"] = True
        elif sign in "~_":
            self.emit("\xa0" if sign == "~" else "-")
        elif sign in "\r\n":
            self.paragraph()


def parse_rtf(source: str) -> tuple[dict, list[tuple]]:
    """Metadata (title, author, created) and paragraphs."""
    if not source.lstrip(WS).startswith("{\\rtf"):
        raise ValueError("no RTF header")
    r = _Rtf()
    for m in _RTF.finditer(source):
        if m[1] == "{":
            r.flush()
            r.stack.append(dict(r.stack[-1]))
        elif m[1]:
            r.flush()
            if len(r.stack) > 1:
                r.stack.pop()
        elif m[2]:
            r.word(m[2], m[3])
        elif m[4] is not None:
            if re.fullmatch(r"[0-9a-fA-F]{1,2}|\+[0-9a-fA-F]", m[4]):
                r.emit(_byte(int(m[4], 16)))
        elif m[5]:
            r.symbol(m[5])
        elif m[6]:
            r.emit(m[6])
    r.paragraph()
    created = None
    if len(r.created) == 3:
        created = f"{r.created['yr']:04d}-{r.created['mo']:02d}-{r.created['dy']:02d}"
    return {"title": r.fields.get("title", "").strip(WS) or None, "author": r.fields.get("author", "").strip(WS) or None, "created": created}, r.blocks
