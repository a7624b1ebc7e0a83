"""Born-digital PDF files to glyphs: objects, cross-references (tables, streams, or a scan of the
file), filters, fonts with their widths and Unicode maps, and the text operators.

A glyph is (x, y, size, end, text) with y growing downwards. What a page can't render is left
out; a file that can't be read, or that is encrypted, is an error.
"""

from __future__ import annotations

import binascii
import functools
import math
import re
import zlib
from collections.abc import Iterator

from ...functions.text import WS
from ...functions.values import py_pdf_date

MAX_STREAM = 1 << 28
_TOKEN = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_SPACE = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
#: Space, then an integer, a name without escapes, a string without any or brackets, another token, or nothing.
_NEXT = re.compile(
    rb"(?:[\0\t\n\f\r ]++|%[^\r\n]*+)*+(?:([+-]?[0-9]{1,18}+)(?![^\0\t\n\f\r ()<>\[\]{}/%])|/([^\0\t\n\f\r ()<>\[\]{}/%#]*+)(?!#)"
    rb"|\(([^()\\]*+)\)|([^\0\t\n\f\r ()<>\[\]{}/%]++))?"
)


class TooLarge(RuntimeError):
    """Not one of the errors that cost a page alone."""


def _inflated(data: bytes, wbits: int = 15) -> bytes:
    """A stream that would fill more than MAX_STREAM bytes is an error, never cut."""
    z = zlib.decompressobj(wbits)
    out = z.decompress(data, MAX_STREAM)
    if len(out) == MAX_STREAM and not z.eof:
        raise TooLarge(f"a stream of more than {MAX_STREAM} bytes")
    return out


class Name(str):
    __slots__ = ()


class Ref(tuple):
    """(object number, generation)"""

    __slots__ = ()


class Word(bytes):
    """A keyword or operator."""

    __slots__ = ()


class Stream:
    __slots__ = ("info", "raw")

    def __init__(self, info: dict, raw: bytes):
        self.info, self.raw = info, raw


END = Word(b"")
_NAMED = {b"true": True, b"false": False, b"null": None}


class Lexer:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def space(self) -> None:
        self.at = _SPACE.match(self.data, self.at).end()

    def value(self, depth: int = 0):
        """The next object, keyword, or END. References are put together by the caller of
        arrays and dictionaries, that is here as well."""
        if depth > 200:
            raise ValueError("objects nest too deep")
        d = self.data
        m = _NEXT.match(d, self.at)
        at = self.at = m.end()
        which = m.lastindex
        if which == 1:
            return int(m[1])
        if which == 2:
            return Name(m[2].decode("latin-1"))
        if which == 3:
            return m[3]
        if which == 4:
            word = m[4]
            if word[0] in b"+-.0123456789":
                try:
                    return int(word)
                except ValueError:
                    n = re.match(rb"[+-]*[0-9]*\.?[0-9]*", word)[0]
                    try:
                        return float(n.replace(b"--", b"-"))
                    except ValueError:
                        return 0
            return _NAMED.get(word) if word in _NAMED else Word(word)
        if at >= len(d):
            return END
        c = d[at]
        if c == 0x2F:
            m = _TOKEN.match(d, at + 1)
            self.at = m.end() if m else at + 1
            raw = re.sub(rb"#([0-9a-fA-F]{2})", lambda x: bytes([int(x[1], 16)]), m[0] if m else b"")
            return Name(raw.decode("latin-1"))
        if c == 0x28:
            return self.string()
        if c == 0x3C:
            if d[at + 1 : at + 2] == b"<":
                self.at = at + 2
                return self.dictionary(depth)
            stop = d.find(b">", at)
            stop = len(d) if stop < 0 else stop
            self.at = stop + 1
            digits = re.sub(rb"[^0-9a-fA-F]", b"", d[at + 1 : stop])
            return binascii.unhexlify(digits + b"0" * (len(digits) % 2))
        if c == 0x5B:
            self.at = at + 1
            return self.array(depth)
        self.at = at + (2 if d[at : at + 2] == b">>" else 1)
        return Word(d[at : self.at])

    def array(self, depth: int) -> list:
        out: list = []
        while True:
            v = self.value(depth + 1)
            if isinstance(v, Word):
                if v in (b"]", END):
                    return out
                if v == b"R" and len(out) >= 2:
                    out[-2:] = [Ref(out[-2:])]
                continue
            out.append(v)

    def dictionary(self, depth: int) -> dict:
        flat: list = []
        while True:
            v = self.value(depth + 1)
            if isinstance(v, Word):
                if v == b"R" and len(flat) >= 2:
                    flat[-2:] = [Ref(flat[-2:])]
                    continue
                if v in (b">>", END):
                    break
                continue
            flat.append(v)
        return {k: v for k, v in zip(flat[::2], flat[1::2]) if isinstance(k, Name)}

    def string(self) -> bytes:
        d, at, depth, out = self.data, self.at + 1, 1, bytearray()
        while at < len(d):
            c = d[at]
            if c == 0x5C:
                n = d[at + 1 : at + 2]
                m = re.compile(rb"[0-7]{1,3}").match(d, at + 1)
                if m:
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
                    continue
                if n in b"\r\n" and n:
                    at += 3 if d[at + 1 : at + 3] == b"\r\n" else 2
                    continue
                out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(n, n)
                at += 2
                continue
            depth += (c == 0x28) - (c == 0x29)
            at += 1
            if not depth:
                break
            out.append(c)
        self.at = at
        return bytes(out)


def _predicted(data: bytes, parms: dict) -> bytes:
    kind = parms.get("Predictor", 1)
    if kind < 2:
        return data
    colors, bits, columns = parms.get("Colors", 1), parms.get("BitsPerComponent", 8), parms.get("Columns", 1)
    step, width = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    out = bytearray()
    if kind == 2:
        for row in range(0, len(data), width):
            line = bytearray(data[row : row + width])
            for k in range(step, len(line)):
                line[k] = (line[k] + line[k - step]) & 255
            out += line
        return bytes(out)
    above = bytearray(width)
    for row in range(0, len(data), width + 1):
        how, line = data[row], bytearray(data[row + 1 : row + 1 + width])
        for k in range(len(line)):
            a, b = line[k - step] if k >= step else 0, above[k]
            if how == 1:
                line[k] = (line[k] + a) & 255
            elif how == 2:
                line[k] = (line[k] + b) & 255
            elif how == 3:
                line[k] = (line[k] + (a + b) // 2) & 255
            elif how == 4:
                c = above[k - step] if k >= step else 0
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[k] = (line[k] + near) & 255
        out += line
        above = line + bytearray(width - len(line))
    return bytes(out)


def _lzw(data: bytes, early: int) -> bytes:
    table = [bytes([k]) for k in range(256)] + [b"", b""]
    out, bits, held, width, last = bytearray(), 0, 0, 9, b""
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        while held >= width:
            code = bits >> (held - width) & ((1 << width) - 1)
            held -= width
            bits &= (1 << held) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                del table[258:]
                width, last = 9, b""
                continue
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last:
                table.append(last + entry[:1])
            last = entry
            width = 9 + sum(len(table) + early > n for n in (511, 1023, 2047))
    return bytes(out)


class Pdf:
    def __init__(self, raw: bytes):
        start = raw.find(b"%PDF-", 0, 1024)
        if start < 0:
            raise ValueError("no PDF header")
        self.data = raw[start:]
        self.offsets: dict[int, tuple[int, int]] = {}  # number: (0, offset) or (stream object, index)
        self.trailer: dict = {}
        self.objects: dict[int, object] = {}
        try:
            self.follow()
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                raise ValueError("no catalogue")
            self.pages = list(self.walk())
        except (ValueError, IndexError, TypeError, KeyError, zlib.error):
            self.rebuild()
            self.pages = list(self.walk())
        if "Encrypt" in self.trailer:
            raise ValueError("the file is encrypted")

    # -- objects --

    def follow(self) -> None:
        """Cross-references, newest first."""
        at = self.data.rfind(b"startxref")
        if at < 0:
            raise ValueError("no cross-reference")
        waiting, seen = [Lexer(self.data, at + 9).value()], set()
        while waiting:
            at = waiting.pop(0)
            if not isinstance(at, int) or at in seen or not 0 <= at < len(self.data):
                if not self.trailer:
                    raise ValueError("bad cross-reference")
                continue
            seen.add(at)
            lexer = Lexer(self.data, at)
            if (first := lexer.value()) == b"xref":
                info = self.table(lexer)
            else:
                if not isinstance(first, int):
                    raise ValueError("bad cross-reference")
                info = self.table_stream(at)
            self.trailer = info | self.trailer
            waiting += [info[k] for k in ("XRefStm", "Prev") if k in info]

    def table(self, lexer: Lexer) -> dict:
        while isinstance(first := lexer.value(), int):
            for number in range(first, first + int(lexer.value())):
                offset, _, kind = lexer.value(), lexer.value(), lexer.value()
                if kind == b"n":
                    self.offsets.setdefault(number, (0, offset))
        if first != b"trailer":
            raise ValueError("no trailer")
        info = lexer.value()
        if not isinstance(info, dict):
            raise ValueError("no trailer")
        return info

    def table_stream(self, at: int) -> dict:
        s = self.at(at)
        if not isinstance(s, Stream):
            raise ValueError("no cross-reference stream")
        data, widths = self.decoded(s), s.info["W"]
        index = s.info.get("Index", [0, s.info.get("Size", 0)])
        row = 0
        for first, count in zip(index[::2], index[1::2]):
            for number in range(first, first + count):
                fields = []
                for k, w in enumerate(widths):
                    fields.append(int.from_bytes(data[row : row + w], "big") if w else (1 if k == 0 else 0))
                    row += w
                if fields[0] == 1:
                    self.offsets.setdefault(number, (0, fields[1]))
                elif fields[0] == 2:
                    self.offsets.setdefault(number, (fields[1], fields[2]))
        return s.info

    def rebuild(self) -> None:
        """From a scan for objects, if the cross-references are of no use."""
        self.offsets, self.objects, self.trailer = {}, {}, {}
        for m in re.finditer(rb"(?<![0-9])([0-9]{1,10})[\0\t\n\f\r ]+[0-9]{1,5}[\0\t\n\f\r ]+obj\b", self.data):
            self.offsets[int(m[1])] = (0, m.start())
        for m in re.finditer(rb"trailer", self.data):
            info = Lexer(self.data, m.end()).value()
            if isinstance(info, dict):
                self.trailer |= info
        for number in list(self.offsets):
            try:
                o = self.get(Ref((number, 0)))
            except (ValueError, IndexError, TypeError, zlib.error):
                continue
            if isinstance(o, Stream) and o.info.get("Type") == "ObjStm":
                inner = Lexer(self.decoded(o))
                for k in range(int(self.get(o.info.get("N", 0)) or 0)):
                    own = inner.value()
                    inner.value()
                    if isinstance(own, int):
                        self.offsets.setdefault(own, (number, k))
            if isinstance(o, Stream) and o.info.get("Type") == "XRef":
                self.trailer = o.info | self.trailer
            if isinstance(o, dict) and o.get("Type") == "Catalog" and "Root" not in self.trailer:
                self.trailer["Root"] = Ref((number, 0))
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            raise ValueError("no catalogue")

    def at(self, offset: int):
        lexer = Lexer(self.data, offset)
        number, _, word = lexer.value(), lexer.value(), lexer.value()
        if word != b"obj" or not isinstance(number, int):
            raise ValueError("no object where one should be")
        found = lexer.value()
        if isinstance(found, int):  # an object may be a reference
            mark = lexer.at
            if isinstance(g := lexer.value(), int) and lexer.value() == b"R":
                return self.get(Ref((found, g)))
            lexer.at = mark
        if isinstance(found, dict):
            lexer.space()
            if self.data.startswith(b"stream", lexer.at):
                begin = lexer.at + 6
                begin += 2 if self.data[begin : begin + 2] == b"\r\n" else 1
                size = self.get(found.get("Length"))
                if not isinstance(size, int) or not re.match(rb"[\0\t\n\f\r ]*endstream", self.data[begin + size : begin + size + 20]):
                    stop = self.data.find(b"endstream", begin)
                    size = (len(self.data) if stop < 0 else stop) - begin
                return Stream(found, self.data[begin : begin + size])
        return found

    def get(self, o):
        """What a reference stands for; other objects as they are."""
        for _ in range(20):
            if not isinstance(o, Ref):
                return o
            number = o[0]
            if number not in self.objects:
                self.objects[number] = None
                place = self.offsets.get(number)
                if place is not None:
                    self.objects[number] = self.at(place[1]) if not place[0] else self.packed(*place)
            o = self.objects[number]
        return None

    def packed(self, holder: int, index: int):
        s = self.get(Ref((holder, 0)))
        if not isinstance(s, Stream):
            return None
        data = self.decoded(s)
        head = Lexer(data)
        numbers = [head.value() for _ in range(2 * int(self.get(s.info["N"])))]
        lexer = Lexer(data, int(self.get(s.info["First"])) + numbers[2 * index + 1])
        return lexer.value()

    def decoded(self, s: Stream) -> bytes:
        data = s.raw
        names, parms = self.get(s.info.get("Filter")), self.get(s.info.get("DecodeParms"))
        names = names if isinstance(names, list) else [] if names is None else [names]
        parms = parms if isinstance(parms, list) else [parms]
        for k, name in enumerate(names):
            own = self.get(parms[k]) if k < len(parms) else None
            own = {x: self.get(v) for x, v in own.items()} if isinstance(own, dict) else {}
            name = self.get(name)
            if name in ("FlateDecode", "Fl"):
                try:
                    data = _predicted(_inflated(data), own)
                except zlib.error:
                    data = _predicted(_inflated(data[2:], -15), own)
            elif name in ("LZWDecode", "LZW"):
                data = _predicted(_lzw(data, own.get("EarlyChange", 1)), own)
            elif name in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9a-fA-F]", b"", data.split(b">")[0])
                data = binascii.unhexlify(digits + b"0" * (len(digits) % 2))
            elif name in ("ASCII85Decode", "A85"):
                data = _ascii85(data)
            elif name in ("RunLengthDecode", "RL"):
                data = _run_length(data)
            else:
                raise ValueError(f"filter {name}")
        return data

    # -- pages --

    def walk(self) -> Iterator[dict]:
        """Page dictionaries in order, with what they inherit."""
        root = self.get(self.get(self.trailer["Root"]).get("Pages"))
        if not isinstance(root, dict):
            raise ValueError("no page tree")
        waiting, seen = [(root, {})], set()
        while waiting:
            node, above = waiting.pop()
            if not isinstance(node, dict) or id(node) in seen:
                continue
            seen.add(id(node))
            own = above | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                waiting += [(self.get(k), own) for k in reversed(kids)]
            else:
                yield node | own

    def metadata(self) -> dict:
        meta: dict = {"page_count": len(self.pages)}
        info = self.get(self.trailer.get("Info"))
        if isinstance(info, dict):
            for key, name in (("title", "Title"), ("author", "Author"), ("created", "CreationDate")):
                v = self.get(info.get(name))
                said = _text_string(v).strip(WS) if isinstance(v, bytes) else ""
                meta[key] = (py_pdf_date(said) if key == "created" else said) if said else None
        return meta

    def glyphs(self, page: dict) -> list[tuple[float, float, float, float, str]]:
        box = self.get(page.get("MediaBox"))
        box = [self.get(v) for v in box] if isinstance(box, list) and len(box) == 4 else [0, 0, 612, 792]
        contents = self.get(page.get("Contents"))
        parts = contents if isinstance(contents, list) else [contents]
        streams = [s for s in map(self.get, parts) if isinstance(s, Stream)]
        painter = _Painter(self, box[3] - box[1])
        try:
            painter.run(b"\n".join(self.decoded(s) for s in streams), self.get(page.get("Resources")) or {}, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), 0)
        except (ValueError, IndexError, TypeError, KeyError, AttributeError, zlib.error, OverflowError, ZeroDivisionError):
            pass  # what came before the fault stays
        return painter.out


def _ascii85(data: bytes) -> bytes:
    data = re.sub(rb"\s", b"", data.split(b"~>")[0]).removeprefix(b"<~")
    out, group = bytearray(), []
    for c in data:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (sum(v * 85 ** (4 - k) for k, v in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = len(group)
        group += [84] * (5 - n)
        out += (sum(v * 85 ** (4 - k) for k, v in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")[: n - 1]
    return bytes(out)


def _run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def _text_string(raw: bytes) -> str:
    if raw[:2] == b"\xfe\xff":
        body = raw[2:]
        return body[: len(body) // 2 * 2].decode("utf-16-be", "replace")
    return raw.decode("latin-1")


# ------------------------------------------------------------------ fonts --

# Advance widths of the standard fonts for codes 32 to 126, in thousandths of an em.
_HELVETICA = (278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, *[556] * 10, 278, 278, 584, 584, 584, 556, 1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556, 333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584)
_HELVETICA_BOLD = (278, 333, 474, 556, 556, 889, 722, 238, 333, 333, 389, 584, 278, 333, 278, 278, *[556] * 10, 333, 333, 584, 584, 584, 611, 975, 722, 722, 722, 722, 667, 611, 778, 722, 278, 556, 722, 611, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 333, 278, 333, 584, 556, 333, 556, 611, 556, 611, 556, 333, 611, 611, 278, 278, 556, 278, 889, 611, 611, 611, 611, 389, 556, 333, 611, 556, 778, 556, 556, 500, 389, 280, 389, 584)
_TIMES = (250, 333, 408, 500, 500, 833, 778, 180, 333, 333, 500, 564, 250, 333, 250, 278, *[500] * 10, 278, 278, 564, 564, 564, 444, 921, 722, 667, 667, 722, 611, 556, 722, 722, 333, 389, 722, 611, 889, 722, 722, 556, 722, 667, 556, 611, 722, 722, 944, 722, 722, 611, 333, 278, 333, 469, 500, 333, 444, 500, 444, 500, 444, 333, 500, 500, 278, 278, 500, 278, 778, 500, 500, 500, 500, 333, 389, 278, 500, 500, 722, 500, 500, 444, 480, 200, 480, 541)
_TIMES_BOLD = (250, 333, 555, 500, 500, 1000, 833, 278, 333, 333, 500, 570, 250, 333, 250, 278, *[500] * 10, 333, 333, 570, 570, 570, 500, 930, 722, 667, 722, 722, 667, 611, 778, 778, 389, 500, 778, 667, 944, 722, 778, 611, 778, 722, 556, 667, 722, 722, 1000, 722, 722, 667, 333, 278, 333, 581, 500, 333, 500, 556, 444, 556, 444, 333, 500, 556, 278, 333, 556, 278, 833, 556, 500, 556, 556, 444, 389, 333, 556, 500, 722, 500, 500, 444, 394, 220, 394, 520)
LIGATURES = {"fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl"}
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "quoteright": "’", "quoteleft": "‘", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "minus": "−", "period": ".", "slash": "/",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "bullet": "•", "dagger": "†", "daggerdbl": "‡", "ellipsis": "…", "emdash": "—", "endash": "–", "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„", "quotesinglbase": "‚", "guilsinglleft": "‹", "guilsinglright": "›", "guillemotleft": "«", "guillemotright": "»", "trademark": "™", "copyright": "©", "registered": "®", "degree": "°", "section": "§", "paragraph": "¶", "Euro": "€", "sterling": "£", "yen": "¥", "cent": "¢", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "dotlessi": "ı", "lslash": "ł", "Lslash": "Ł", "nbspace": "\xa0", "periodcentered": "·", "multiply": "×", "divide": "÷", "plusminus": "±", "mu": "µ", "exclamdown": "¡", "questiondown": "¿", "ordfeminine": "ª", "ordmasculine": "º", "eth": "ð", "Eth": "Ð", "thorn": "þ", "Thorn": "Þ", "onehalf": "½", "onequarter": "¼", "threequarters": "¾",
} | LIGATURES
_ACCENTS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "cedilla": "̧", "caron": "̌", "ring": "̊", "ogonek": "̨", "macron": "̄", "breve": "̆", "dotaccent": "̇", "hungarumlaut": "̋"}


def _glyph_text(name: str) -> str:
    """What a glyph's name stands for."""
    import unicodedata

    name = name.split(".")[0]
    if name in GLYPHS:
        return GLYPHS[name]
    if len(name) == 1:
        return name
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", name):
        digits = [m[1][k : k + 4] for k in range(0, len(m[1]), 4)] if m[1] else [m[2]]
        return "".join(chr(int(x, 16)) for x in digits if int(x, 16) < 0x110000 and not 0xD800 <= int(x, 16) < 0xE000)
    for accent, mark in _ACCENTS.items():
        if name.endswith(accent) and len(name) == len(accent) + 1:
            return unicodedata.normalize("NFC", name[0] + mark)
    return ""


def _standard(code: int) -> str:
    return {0x27: "’", 0x60: "‘", 0xAE: "fi", 0xAF: "fl", 0xB1: "–", 0xD0: "—", 0xAA: "“", 0xBA: "”", 0xB7: "•", 0xBC: "…"}.get(code, chr(code) if code < 127 else "")


@functools.lru_cache(8)
def _plain(codec: str | None) -> dict[int, str]:
    """Codes of a simple font to text."""
    return {c: bytes([c]).decode(codec, "ignore") if codec else _standard(c) for c in range(32, 256)}


@functools.lru_cache(4)
def _widths(table: tuple[int, ...]) -> dict[int, float]:
    return {32 + k: float(w) for k, w in enumerate(table)}


class Font:
    def __init__(self, pdf: Pdf, info: dict):
        self.wide = pdf.get(info.get("Subtype")) == "Type0"
        self.matrix = 0.001
        self.map: dict[int, str] = {}
        self.widths: dict[int, float] = {}
        self.default = 0.0
        self.code_bytes = [2] if self.wide else [1]
        cmap = pdf.get(info.get("ToUnicode"))
        if isinstance(cmap, Stream):
            self.unicode_map(pdf.decoded(cmap))
        base = str(pdf.get(info.get("BaseFont")) or "").partition("+")[2] or str(pdf.get(info.get("BaseFont")) or "")
        if self.wide:
            self.composite(pdf, info)
        else:
            self.simple(pdf, info, base)

    def simple(self, pdf: Pdf, info: dict, base: str) -> None:
        encoding = pdf.get(info.get("Encoding"))
        name = pdf.get(encoding.get("BaseEncoding")) if isinstance(encoding, dict) else encoding
        codec = {"MacRomanEncoding": "mac-roman", "WinAnsiEncoding": "cp1252"}.get(name)
        plain = _plain(codec)
        if isinstance(encoding, dict):
            plain, code = dict(plain), 0
            for d in pdf.get(encoding.get("Differences")) or []:
                d = pdf.get(d)
                if isinstance(d, Name):
                    plain[code] = _glyph_text(d)
                    code += 1
                elif isinstance(d, (int, float)):
                    code = int(d)
        self.map = plain | self.map
        first, widths = pdf.get(info.get("FirstChar")) or 0, pdf.get(info.get("Widths"))
        about = pdf.get(info.get("FontDescriptor"))
        if isinstance(about, dict):
            self.default = float(pdf.get(about.get("MissingWidth")) or 0)
        if pdf.get(info.get("Subtype")) == "Type3":
            own = pdf.get(info.get("FontMatrix")) or [0.001]
            self.matrix = float(own[0])
        if isinstance(widths, list):
            self.widths = {first + k: float(pdf.get(w) or 0) for k, w in enumerate(widths)}
            return
        low = base.lower()
        bold = "bold" in low
        if "courier" in low:
            self.default = 600.0
            return
        table = (_TIMES_BOLD if bold else _TIMES) if "times" in low or "roman" in low else _HELVETICA_BOLD if bold else _HELVETICA
        self.widths = _widths(table)
        self.default = self.default or 556.0

    def composite(self, pdf: Pdf, info: dict) -> None:
        below = pdf.get((pdf.get(info.get("DescendantFonts")) or [None])[0])
        self.default = 1000.0
        if not isinstance(below, dict):
            return
        self.default = float(pdf.get(below.get("DW", 1000)))
        spans = [pdf.get(v) for v in pdf.get(below.get("W")) or []]
        k = 0
        while k + 1 < len(spans):
            if isinstance(spans[k + 1], list):
                for j, w in enumerate(spans[k + 1]):
                    self.widths[spans[k] + j] = float(pdf.get(w))
                k += 2
            else:
                if k + 2 < len(spans):
                    for code in range(spans[k], min(spans[k + 1], spans[k] + 65536) + 1):
                        self.widths[code] = float(spans[k + 2])
                k += 3

    def unicode_map(self, data: bytes) -> None:
        lexer, waiting = Lexer(data), []
        sizes: set[int] = set()
        while (v := lexer.value()) != END or not isinstance(v, Word):
            if not isinstance(v, Word):
                waiting.append(v)
                continue
            if v.startswith(b"begin"):
                waiting = []
            elif v == b"endcodespacerange":
                sizes |= {len(x) for x in waiting if isinstance(x, bytes)}
            elif v == b"endbfchar":
                for code, said in zip(waiting[::2], waiting[1::2]):
                    if isinstance(code, bytes) and isinstance(said, bytes):
                        self.map[int.from_bytes(code, "big")] = said.decode("utf-16-be", "replace")
            elif v == b"endbfrange":
                for low, high, said in zip(waiting[::3], waiting[1::3], waiting[2::3]):
                    low, high = int.from_bytes(low, "big"), int.from_bytes(high, "big")
                    for k in range(min(high - low + 1, 65536)):
                        if isinstance(said, list):
                            if k < len(said):
                                self.map[low + k] = said[k].decode("utf-16-be", "replace")
                        else:
                            last = int.from_bytes(said[-2:], "big") + k
                            self.map[low + k] = (said[:-2] + (last & 0xFFFF).to_bytes(2, "big")).decode("utf-16-be", "replace")
        if self.wide and sizes:
            self.code_bytes = sorted(s for s in sizes if s)

    def codes(self, raw: bytes) -> Iterator[int]:
        step = self.code_bytes[-1] if self.wide else 1
        for k in range(0, len(raw), step):
            yield int.from_bytes(raw[k : k + step], "big")


# --------------------------------------------------------------- painting --

Matrix = tuple[float, float, float, float, float, float]


def _times(a: Matrix, b: Matrix) -> Matrix:
    """First a, then b."""
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


class _Advances(dict):
    """Of a font's codes: (advance, width, text), each when it first comes up."""

    def __init__(self, font: Font, size: float, char: float, word: float, scale: float, stretch: float, shape: float):
        self.font, self.about = font, (size, char, word, scale, stretch, shape)

    def __missing__(self, code: int) -> tuple[float, float, str]:
        size, char, word, scale, stretch, shape = self.about
        w = self.font.widths.get(code, self.font.default) * self.font.matrix
        self[code] = found = (w * size + char + (word if code == 32 else 0.0)) * scale * stretch, w * shape, self.font.map.get(code, "")
        return found


class _Painter:
    MAX_FORMS = 12

    def __init__(self, pdf: Pdf, height: float):
        self.pdf, self.height, self.out, self.fonts = pdf, height, [], {}
        self.advances: dict[tuple, _Advances] = {}

    def font(self, resources: dict, name: str) -> Font | None:
        info = self.pdf.get((self.pdf.get(resources.get("Font")) or {}).get(name))
        if not isinstance(info, dict):
            return None
        if id(info) not in self.fonts:
            self.fonts[id(info)] = Font(self.pdf, info)
        return self.fonts[id(info)]

    def run(self, data: bytes, resources: dict, ctm: Matrix, depth: int) -> None:
        lexer, args = Lexer(data), []
        state = {"ctm": ctm, "font": None, "size": 0.0, "char": 0.0, "word": 0.0, "scale": 1.0, "lead": 0.0, "rise": 0.0}
        saved: list[dict] = []
        line = text = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)

        def show(raw: bytes) -> None:
            nonlocal text
            font, size = state["font"], state["size"]
            if font is None:
                return
            t0, t1, t2, t3, t4, t5 = text
            c0, c1, c2, c3, c4, c5 = state["ctm"]
            char, scale, rise = state["char"], state["scale"], state["rise"]
            word = 0.0 if font.wide else state["word"]
            # All glyphs of a string have the same matrix but for its place.
            a0, a1 = scale * t0, scale * t1
            shape = math.sqrt(abs(size * (a0 * c0 + a1 * c2 + (t2 * c0 + t3 * c2)) * size * (a0 * c1 + a1 * c3 + (t2 * c1 + t3 * c3))))
            up, across, height, put = rise * t3, rise * t2, self.height, self.out.append
            widths, default, matrix, said_by = font.widths.get, font.default, font.matrix, font.map.get
            try:
                if not (t1 or c1 or c2 or rise):
                    # Upright text: a code's advance and width don't depend on its place, nor does y on x.
                    key = (id(font), size, char, word, scale, t0, shape)
                    known = self.advances.get(key) or self.advances.setdefault(key, _Advances(font, *key[1:]))
                    y = height - (t5 * c3 + c5)
                    for step, wide, said in [known[code] for code in (font.codes(raw) if font.wide else raw)]:
                        if said:
                            x = t4 * c0 + c4
                            put((x, y, shape, x + wide, said))
                        t4 += step
                    return
                for code in font.codes(raw) if font.wide else raw:
                    w = widths(code, default) * matrix
                    if said := said_by(code):
                        e, f = across + t4, up + t5
                        x = e * c0 + f * c2 + c4
                        put((x, height - (e * c1 + f * c3 + c5), shape, x + w * shape, said))
                    step = (w * size + char + (word if code == 32 else 0.0)) * scale
                    t4, t5 = step * t0 + t4, step * t1 + t5
            finally:
                text = (t0, t1, t2, t3, t4, t5)

        def move(x: float, y: float) -> None:
            nonlocal line, text
            line = text = _times((1.0, 0.0, 0.0, 1.0, x, y), line)

        while True:
            v = lexer.value()
            if v.__class__ is not Word:
                args.append(v)
                if len(args) > 1000:
                    args = []
                continue
            if v == END:
                return
            op, a = v, args
            args = []
            if op == b"Tj":
                show(a[0])
            elif op == b"TJ":
                for x in a[0]:
                    if isinstance(x, bytes):
                        show(x)
                    elif isinstance(x, (int, float)):
                        text = _times((1.0, 0.0, 0.0, 1.0, -x / 1000 * state["size"] * state["scale"], 0.0), text)
            elif op in (b"'", b'"'):
                if op == b'"':
                    state["word"], state["char"] = a[0], a[1]
                move(0, -state["lead"])
                show(a[-1])
            elif op == b"BT":
                line = text = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
            elif op in (b"Td", b"TD"):
                if op == b"TD":
                    state["lead"] = -a[1]
                move(a[0], a[1])
            elif op == b"Tm":
                line = text = tuple(map(float, a[:6]))
            elif op == b"T*":
                move(0, -state["lead"])
            elif op == b"Tf":
                state["font"], state["size"] = self.font(resources, a[0]), float(a[1])
            elif op in (b"Tc", b"Tw", b"TL", b"Ts"):
                state[{b"Tc": "char", b"Tw": "word", b"TL": "lead", b"Ts": "rise"}[op]] = float(a[0])
            elif op == b"Tz":
                state["scale"] = a[0] / 100
            elif op == b"cm":
                state["ctm"] = _times(tuple(map(float, a[:6])), state["ctm"])
            elif op == b"q":
                saved.append(dict(state))
            elif op == b"Q":
                state = saved.pop() if saved else state
            elif op == b"Do" and depth < self.MAX_FORMS:
                form = self.pdf.get((self.pdf.get(resources.get("XObject")) or {}).get(a[0]))
                if isinstance(form, Stream) and self.pdf.get(form.info.get("Subtype")) == "Form":
                    own = self.pdf.get(form.info.get("Matrix")) or [1, 0, 0, 1, 0, 0]
                    inner = self.pdf.get(form.info.get("Resources")) or resources
                    self.run(self.pdf.decoded(form), inner, _times(tuple(float(self.pdf.get(x)) for x in own), state["ctm"]), depth + 1)
            elif op == b"BI":
                m = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ]|$)").search(data, lexer.at)
                lexer.at = m.end() if m else len(data)


def parse(raw: bytes, pages: tuple[int, int | None] | None = None) -> tuple[dict, list[tuple[int, list[tuple]]]]:
    """Metadata, and (page number, glyphs) of the chosen pages; pages is first and last, from 1."""
    pdf = Pdf(raw)
    chosen = [k for k in range(1, len(pdf.pages) + 1) if pages is None or pages[0] <= k and (pages[1] is None or k <= pages[1])]
    return pdf.metadata(), [(k, pdf.glyphs(pdf.pages[k - 1])) for k in chosen]
