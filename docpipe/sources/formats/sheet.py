"""Workbooks to blocks: for each sheet that holds something its name and a table.

A sheet's table starts at its first used cell and ends at its last used row and column. In
xlsx, numbers whose format shows a date are dates (the 1904 calendar is followed), formats with
elapsed hours are durations. In ods, repeated cells and rows count as often as they repeat; a
repeated empty tail doesn't.
"""

from __future__ import annotations

import posixpath
import re

from ...functions.blocks import text
from ...functions.text import WS
from ...functions.values import py_duration, py_number, py_serial_date
from .archive import Archive, Element, maybe_xml, parse_xml
from .office import core_properties, odf_metadata, relationships

BUILTIN_DATES = frozenset([*range(14, 23), 45, 47])
BUILTIN_DURATIONS = frozenset([46])


def _kind(number: int, code: str | None) -> str:
    """number, date or duration."""
    if code is None:
        return "duration" if number in BUILTIN_DURATIONS else "date" if number in BUILTIN_DATES else "number"
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.', "", code).lower()
    if re.search(r"\[(h+|m+|s+)\]", bare):
        return "duration"
    bare = re.sub(r"\[[^\]]*\]", "", bare).split(";")[0]
    return "date" if re.search(r"[dmyhs]", re.sub("general", "", bare)) else "number"


_REFERENCE = re.compile("([A-Z]{1,3})([0-9]+)")


def _place(ref: str) -> tuple[int, int] | None:
    m = _REFERENCE.fullmatch(ref)
    if not m:
        return None
    column = 0
    for c in m[1]:
        column = column * 26 + ord(c) - 64
    return int(m[2]) - 1, column - 1


def _table(name: str, cells: dict[tuple[int, int], str]) -> list[tuple]:
    if not cells:
        return []
    top, bottom = min(r for r, _ in cells), max(r for r, _ in cells)
    left, right = min(c for _, c in cells), max(c for _, c in cells)
    rows = [[text(cells.get((r, c), "")) for c in range(left, right + 1)] for r in range(top, bottom + 1)]
    return [("heading", 2, text(name)), ("table", rows[0], rows[1:])]


def _said(e: Element) -> str:
    """Text of a string item; its phonetic guides aren't part of it."""
    return "".join(c.text() if c.name == "t" else _said(c) for c in e.elements() if c.name in ("t", "r"))


class Xlsx:
    def __init__(self, archive: Archive):
        self.archive = archive
        shared = maybe_xml(archive.get("xl/sharedStrings.xml"))
        self.shared = [_said(si) for si in shared.find_all("si")] if shared is not None else []
        styles = maybe_xml(archive.get("xl/styles.xml"))
        self.kinds = ["number"]
        if styles is not None:
            codes = {f.number("numFmtId"): f.attrs.get("formatCode", "") for f in styles.find_all("numFmt")}
            formats = styles.find("cellXfs")
            if formats is not None:
                ids = [x.number("numFmtId") or 0 for x in formats.elements() if x.name == "xf"]
                self.kinds = [_kind(n, codes.get(n)) for n in ids]
        self.book = parse_xml(archive.need("xl/workbook.xml"))
        properties = self.book.find("workbookPr")
        self.from_1904 = properties is not None and properties.attrs.get("date1904") in ("1", "true")

    def value(self, c: Element) -> str | None:
        kind, v = c.attrs.get("t", "n"), c.child("v")
        if kind == "inlineStr":
            inline = c.child("is")
            return _said(inline).strip(WS) if inline is not None else None
        said = v.text() if v is not None else ""
        if not said.strip(WS):
            return "" if kind == "str" and v is not None else None
        if kind == "s":
            at = int(said)
            return self.shared[at].strip(WS) if 0 <= at < len(self.shared) else None
        if kind == "b":
            return "TRUE" if said.strip(WS) not in ("0", "false") else "FALSE"
        if kind == "str":
            return said.strip(WS)
        if kind in ("e", "d"):
            return said if kind == "d" else "#" + re.sub(r"\W", "", said).capitalize().replace("Div0", "Div0").replace("Na", "NA")
        try:
            number = float(said)
        except ValueError:
            return said.strip(WS)
        style = c.number("s") or 0
        shown = self.kinds[style] if 0 <= style < len(self.kinds) else "number"
        if shown == "duration":
            return py_duration(number)
        return py_serial_date(number, self.from_1904) if shown == "date" else py_number(number)

    def cells(self, sheet: Element) -> dict[tuple[int, int], str]:
        out: dict[tuple[int, int], str] = {}
        data = sheet.find("sheetData")
        row = -1
        for r in data.elements() if data is not None else ():
            row = n - 1 if (n := r.number("r")) else row + 1
            column = -1
            for c in r.elements():
                at = _place(c.attrs.get("r", ""))
                column = at[1] if at else column + 1
                shown = self.value(c)
                if shown is not None:
                    out[at[0] if at else row, column] = shown
        return out

    def blocks(self) -> list[tuple]:
        places = relationships(self.archive.get("xl/_rels/workbook.xml.rels"))
        out: list[tuple] = []
        for s in self.book.find_all("sheet"):
            target = places.get(s.attrs.get("id", ""))
            if target is None:
                continue
            path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
            sheet = maybe_xml(self.archive.get(path))
            if sheet is not None:
                out += _table(s.attrs.get("name", ""), self.cells(sheet))
        return out


def parse_xlsx(archive: Archive) -> tuple[dict, list[tuple]]:
    return core_properties(archive), Xlsx(archive).blocks()


def _ods_value(c: Element) -> str | None:
    kind, value = c.attrs.get("value-type"), c.attrs.get("value")
    if kind in ("float", "currency", "percentage") and value:
        try:
            return py_number(float(value))
        except ValueError:
            return value
    if kind == "boolean":
        return c.attrs.get("boolean-value", "").upper() or None
    if kind in ("date", "time"):
        return c.attrs.get(f"{kind}-value")
    said = "\n".join(p.text() for p in c.elements() if p.name == "p").strip(WS)
    return said or None


def parse_ods(archive: Archive) -> tuple[dict, list[tuple]]:
    root = parse_xml(archive.need("content.xml"))
    blocks: list[tuple] = []
    for t in root.find_all("table"):
        cells: dict[tuple[int, int], str] = {}
        row = 0
        for r in t.find_all("table-row"):
            found: dict[int, str] = {}
            column = 0
            for c in r.elements():
                if c.name not in ("table-cell", "covered-table-cell"):
                    continue
                times = max(1, c.number("number-columns-repeated") or 1)
                shown = _ods_value(c)
                if shown is not None:
                    found |= {column + k: shown for k in range(min(times, 16384))}
                column += times
            times = max(1, r.number("number-rows-repeated") or 1)
            if found:
                for k in range(min(times, 1 << 20)):
                    cells |= {(row + k, at): v for at, v in found.items()}
            row += times
        blocks += _table(t.attrs.get("name", ""), cells)
    return odf_metadata(archive.get("meta.xml")), blocks
