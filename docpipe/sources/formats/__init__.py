"""Parsers by format: bytes in, metadata and blocks out. EXTRACTORS is the extension point:
register() adds a format or replaces one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from . import markdown, office, pagelayout, pdf, plain, sheet, web
from .archive import Archive

FORMATS = ("txt", "markdown", "csv", "html", "rtf", "docx", "pptx", "xlsx", "odt", "odp", "ods", "epub", "pdf")
Pages = tuple[int, "int | None"] | None
Parser = Callable[[bytes, Pages], tuple[dict, list[tuple]]]


@dataclass
class Failure(Exception):
    """Why an input gave no document; reason is one of REASONS."""

    reason: str
    message: str


REASONS = ("no_text_layer", "unsupported_format", "parse_error", "io_error")
EXIT_CODES = {"no_text_layer": 4, "unsupported_format": 5, "parse_error": 1, "io_error": 1, "usage": 2}


def _decoded(parse: Callable[[str], tuple[dict, list[tuple]]]) -> Parser:
    return lambda raw, _: parse(raw.decode("utf-8", "replace"))


def _zipped(parse: Callable[[Archive], tuple[dict, list[tuple]]]) -> Parser:
    return lambda raw, _: parse(Archive(raw))


def _pdf(raw: bytes, pages: Pages) -> tuple[dict, list[tuple]]:
    meta, found = pdf.parse(raw, pages)
    return meta, pagelayout.blocks(found)


EXTRACTORS: dict[str, Parser] = {
    "txt": _decoded(lambda s: ({}, plain.parse_text(s))), "markdown": _decoded(markdown.parse), "csv": lambda raw, _: ({}, plain.parse_csv(raw)),
    "html": _decoded(web.parse), "rtf": _decoded(plain.parse_rtf), "docx": _zipped(office.parse_docx), "pptx": _zipped(office.parse_pptx),
    "xlsx": _zipped(sheet.parse_xlsx), "odt": _zipped(office.parse_odf), "odp": _zipped(office.parse_odf), "ods": _zipped(sheet.parse_ods),
    "epub": _zipped(office.parse_epub), "pdf": _pdf,
}


def register(name: str, parser: Parser) -> None:
    EXTRACTORS[name] = parser


def page_range(said: str) -> tuple[int, int | None]:
    """"7", "3-9" or "3-"; anything else is a usage error."""
    first, dash, last = said.strip().partition("-")
    number = lambda s: int(s) if s.isascii() and s.removeprefix("+").isdigit() and 0 < int(s) < 1 << 32 else None
    a, b = number(first), number(last) if last else None
    if a is None or last and (b is None or b < a):
        raise ValueError(f"bad page range: {said!r}")
    return a, b if dash else a


def extract(name: str | None, raw: bytes, pages: Pages = None, extractors: dict[str, Parser] | None = None) -> tuple[dict, list[tuple]]:
    """Metadata and blocks, or Failure. Whatever goes wrong in a parser is a parse error of
    that input; it never ends the job."""
    from ...functions.blocks import is_blank

    parser = (extractors or EXTRACTORS).get(name or "")
    if parser is None:
        raise Failure("unsupported_format", "unsupported file type")
    try:
        meta, blocks = parser(raw, pages)
        blank = is_blank(blocks)
    except Failure:
        raise
    except RecursionError as e:
        raise Failure("parse_error", "nested too deep") from e
    except Exception as e:
        raise Failure("parse_error", f"{type(e).__name__}: {e}"[:500]) from e
    if blank:
        raise Failure("no_text_layer", "no extractable text")
    return meta, blocks
