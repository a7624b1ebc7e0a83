"""Format detection as one Column expression over a file's first bytes and its extension."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HEAD = 8192
ALIASES = {
    "txt": "txt", "text": "txt", "log": "txt", "md": "markdown", "markdown": "markdown", "csv": "csv", "html": "html", "htm": "html", "xhtml": "html", "rtf": "rtf",
    **{x: x for x in ("docx", "pptx", "xlsx", "odt", "odp", "ods", "epub", "pdf")},
}
MIMETYPES = {
    "application/epub+zip": "epub", "application/vnd.oasis.opendocument.text": "odt",
    "application/vnd.oasis.opendocument.presentation": "odp", "application/vnd.oasis.opendocument.spreadsheet": "ods",
}


def extension(path: Column) -> Column:
    """Lower-cased, null without one; a name that only starts with a point has none."""
    name = F.substring_index(path, "/", -1)
    found = F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1)
    return F.when(name.rlike(r"(?s)^.+\.[^.]*$"), F.lower(found))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for value in dict.fromkeys(table.values()):
        out = F.when(key.isin(*(k for k, v in table.items() if v == value)), value).otherwise(out)
    return out


def by_extension(ext: Column) -> Column:
    return _lookup(F.lower(ext), ALIASES)


def _short(chars: Column, at: int) -> Column:
    """The little-endian 16-bit number at a byte of text in which each byte is a character."""
    return F.ascii(F.substring(chars, at + 1, 1)) + 256 * F.ascii(F.substring(chars, at + 2, 1))


def _zip_flavour(chars: Column) -> Column:
    """By the mimetype entry if it comes first, else by the folders that the head names."""
    extra = _short(chars, 28)
    named = (_short(chars, 26) == 8) & (F.substring(chars, 31, 8) == "mimetype")
    value = F.substr(chars, F.lit(39) + extra)
    mimetype = F.when(named, F.regexp_extract(value, "^([A-Za-z0-9.+/-]*?)(?:PK\x03\x04|[^A-Za-z0-9.+/-]|$)", 1)).otherwise("")
    folders = F.when(chars.contains("word/"), "docx").when(chars.contains("ppt/"), "pptx").when(chars.contains("xl/"), "xlsx")
    return F.when(mimetype != "", _lookup(mimetype, MIMETYPES)).otherwise(folders)


def by_signature(head: Column) -> Column:
    chars = F.decode(head, "ISO-8859-1")
    return (
        F.when(chars.startswith("%PDF-"), "pdf").when(chars.startswith("{\\rtf"), "rtf")
        .when(chars.startswith("PK\x03\x04"), _zip_flavour(chars))
    )


def looks_like_html(head: Column) -> Column:
    start = F.lower(F.decode(F.substring(head, 1, 512), "ISO-8859-1"))
    return start.contains("<!doctype html") | start.contains("<html")


def detect(head: Column, ext: Column) -> Column:
    """The format, null if unsupported: what the bytes say goes before the extension."""
    return F.coalesce(by_signature(head), by_extension(ext), F.when(looks_like_html(head), "html"))
