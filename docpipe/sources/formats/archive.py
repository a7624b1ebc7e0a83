"""ZIP containers and XML trees, shared by the office and book formats."""

from __future__ import annotations

import functools
import io
import re
import struct
import zipfile
import zlib
from xml.parsers import expat

from ...functions.text import WS, py_natural_key

MAX_DEPTH = 500


class Archive:
    """Entries of a ZIP by name, as lossy UTF-8. MAX_ENTRY bounds what one entry may unpack
    to, so that a small file can't exhaust an executor."""

    MAX_ENTRY = 1 << 29

    def __init__(self, raw: bytes):
        try:
            self.raw, self.zip = raw, zipfile.ZipFile(io.BytesIO(raw))
        except (zipfile.BadZipFile, OSError, ValueError) as e:
            raise ValueError(f"not a ZIP archive: {e}") from e
        self.names = self.zip.namelist()

    def data(self, name: str) -> bytes | None:
        try:
            info = self.zip.getinfo(name)
            if info.file_size > self.MAX_ENTRY:
                raise ValueError(f"{name} unpacks to {info.file_size} bytes")
            found = self.quick(info)
            return self.zip.read(name) if found is None else found
        except (KeyError, zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, EOFError):
            return None

    def quick(self, info: zipfile.ZipInfo) -> bytes | None:
        """A whole entry without a file object, if it is as plain as most are and its checksum holds;
        what is wrong with any other is zipfile's to say."""
        raw, at = self.raw, info.header_offset
        if info.flag_bits & 0x61 or info.compress_type not in (0, 8) or raw[at : at + 4] != b"PK\x03\x04" or len(raw) < at + 30:
            return None
        name, extra = struct.unpack_from("<HH", raw, at + 26)
        begin = at + 30 + name
        if raw[at + 30 : begin] != info.orig_filename.encode("ascii", "replace"):
            return None
        body = raw[begin + extra : begin + extra + info.compress_size]
        if info.compress_type:
            z = zlib.decompressobj(-15)
            try:
                body = z.decompress(body, info.file_size + 1)
            except zlib.error:
                return None
            if not z.eof:
                return None
        return body if len(body) == info.file_size and zlib.crc32(body) == info.CRC else None

    def get(self, name: str) -> str | None:
        found = self.data(name)
        return None if found is None else found.decode("utf-8", "replace")

    def need(self, name: str) -> str:
        found = self.get(name)
        if found is None:
            raise ValueError(f"{name} is missing")
        return found

    def under(self, start: str) -> list[str]:
        return sorted((n for n in self.names if n.startswith(start)), key=py_natural_key)


class Element:
    """Local names only; text and elements in order. find() is depth first and takes the
    element itself first; find_all() doesn't look inside what it has found."""

    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []

    def elements(self) -> list[Element]:
        return [c for c in self.children if c.__class__ is not str]

    def number(self, name: str) -> int | None:
        value = self.attrs.get(name, "").strip(WS)
        return int(value) if _INTEGER.fullmatch(value) else None

    def child(self, name: str) -> Element | None:
        for c in self.children:
            if c.__class__ is not str and c.name == name:
                return c
        return None

    def find(self, name: str) -> Element | None:
        if self.name == name:
            return self
        for c in self.children:
            if c.__class__ is not str and (f := c.find(name)) is not None:
                return f
        return None

    def find_all(self, name: str) -> list[Element]:
        out: list[Element] = []
        for c in self.children:
            if c.__class__ is str:
                continue
            if c.name == name:
                out.append(c)
            elif c.children:
                out += c.find_all(name)
        return out

    def text(self) -> str:
        own = self.children
        if len(own) == 1 and own[0].__class__ is str:
            return own[0]
        return "".join([c if c.__class__ is str else c.text() for c in own])

    def said(self, name: str) -> str | None:
        """Trimmed text of the first element of that name below, None if there is none."""
        found = self.find(name)
        return (found.text().strip(WS) or None) if found is not None else None


@functools.lru_cache(4096)
def _local(name: str) -> str:
    return name.rpartition(":")[2]


_INTEGER = re.compile(r"[+-]?[0-9]+")
_DECLARATION = re.compile(r"^\s*<\?xml[^>]*\?>")
_ENTITY = re.compile(r"&(?!(?:lt|gt|amp|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);)[A-Za-z_:][\w:.-]*;")
_DOCTYPE = re.compile(r"<!DOCTYPE[^>\[]*(?:\[[^\]]*\]\s*)?>", re.I)


def parse_xml(source: str) -> Element:
    """The root element. Prefixes need no declaration, unknown entities vanish, and document
    types aren't read, so none of them can expand."""
    source = _ENTITY.sub("", _DOCTYPE.sub("", source.removeprefix("﻿"), count=1))
    source = _DECLARATION.sub("", source)
    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True
    root = Element("", {})
    stack = [root]
    push, pop = stack.append, stack.pop

    def start(name: str, attrs: dict[str, str]) -> None:
        if len(stack) > MAX_DEPTH:
            raise ValueError(f"elements nest more than {MAX_DEPTH} deep")
        local: dict[str, str] = {}
        for k, v in attrs.items():
            local.setdefault(_local(k), v)
        e = Element(_local(name), local)
        stack[-1].children.append(e)
        push(e)

    def chars(data: str) -> None:
        own = stack[-1].children
        if own and isinstance(own[-1], str):
            own[-1] += data
        else:
            own.append(data)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, lambda _: pop(), chars
    try:
        parser.Parse(source.encode("utf-8", "replace"), True)
    except expat.ExpatError as e:
        raise ValueError(f"bad XML: {e}") from e
    return next(iter(root.elements()))


def maybe_xml(source: str | None) -> Element | None:
    if source is None:
        return None
    try:
        return parse_xml(source)
    except (ValueError, StopIteration):
        return None
