"""Markdown (CommonMark with tables, strike-through and task items) to blocks.

Raw HTML and rules are dropped, block quotes are transparent, a soft break is a space. Images
stand behind the paragraph that holds them; those in headings, tables and tight list items
wait for the next paragraph's end.
"""

from __future__ import annotations

import html
import re

from ...functions.blocks import spans_plain, text
from ...functions.text import WS

_ATX = re.compile(r"(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
_RULE = re.compile(r"([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_BULLET = re.compile(r"([-+*])(?=[ \t]|$)|([0-9]{1,9})([.)])(?=[ \t]|$)")
_SETEXT = re.compile(r"(=+|-+)[ \t]*$")
_DELIMITER = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML_BLOCK = (
    (re.compile(r"<(?:script|pre|style|textarea)(?=[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")), (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")), (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(r"</?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?=[\s>]|/>|$)", re.I), None),
)
_TAG = re.compile(r"<(?:[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?|/[A-Za-z][A-Za-z0-9-]*\s*)>")
_OTHER_HTML = re.compile(r"<!--(?:>|->|.*?-->)|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9.+-]{1,31}:[^\s<>\x00-\x1f]*|[\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>", re.A)
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
_TITLE = r"(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\))"
_DEFINITION = re.compile(rf" {{0,3}}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|[^\s<][^\s]*)(?:[ \t]*(?:\n[ \t]*|[ \t]){_TITLE}[ \t]*(?=\n|$)|[ \t]*(?=\n|$))", re.S)
_TITLED = re.compile(rf"[ \t\n]+{_TITLE}", re.S)


def _unescape(s: str) -> str:
    return _ENTITY.sub(lambda m: html.unescape(m[0]), _ESCAPE.sub(r"\1", s))


def _label(s: str) -> str:
    return re.sub(f"[{WS}]+", " ", s).strip().casefold()


def _indent(line: str) -> int:
    n = 0
    for c in line:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - n % 4
        else:
            break
    return n


def _dedent(line: str, n: int) -> str:
    """The line without n columns of leading white space."""
    if line[:n].count(" ") == n:
        return line[n:]
    body = line.lstrip(" \t")
    return " " * max(0, _indent(line) - n) + body


def _cells(line: str) -> list[str]:
    line = line.strip(" \t")
    line = line[1:] if line.startswith("|") else line
    parts = re.split(r"(?<!\\)\|", line)
    if len(parts) > 1 and not parts[-1].strip(" \t"):
        parts.pop()
    return [p.strip(" \t").replace("\\|", "|") for p in parts]


def _html_start(s: str, in_paragraph: bool) -> tuple | None:
    """How the HTML block that starts here ends: (pattern or None for an empty line,)."""
    if not s.startswith("<"):
        return None
    for start, stop in _HTML_BLOCK:
        if start.match(s):
            return (stop,)
    m = _TAG.match(s)
    return (None,) if m and not s[m.end() :].strip() and not in_paragraph else None


def _interrupts(line: str) -> bool:
    """Whether a line ends the paragraph before it."""
    if _indent(line) >= 4:
        return False
    s = line.lstrip(" \t")
    if s.startswith(">") or _ATX.match(s) or _RULE.match(s) or _FENCE.match(s) or _html_start(s, True):
        return True
    m = _BULLET.match(s)
    return bool(m and s[m.end() :].strip() and (m[1] or m[2] == "1"))


class _Parser:
    """Lines to nodes: (kind, ...) with text unparsed, since links may be defined later."""

    MAX_NESTING = 100

    def __init__(self):
        self.references: dict[str, str] = {}

    def blocks(self, lines: list[str], depth: int = 0) -> tuple[list[tuple], bool]:
        """Nodes, and whether an empty line stands between two of them."""
        out: list[tuple] = []
        spaced = blank = False
        at, n = 0, len(lines)
        while at < n:
            line = lines[at]
            if not line.strip(" \t"):
                blank, at = True, at + 1
                continue
            spaced |= blank and bool(out)
            blank = False
            at = self.block(lines, at, out, depth)
            # Empty lines that a block has taken in at its end separate as well.
            blank = not lines[at - 1].strip(" \t") and out[-1:] != [] and out[-1][0] != "code"
        return out, spaced

    def block(self, lines: list[str], at: int, out: list[tuple], depth: int) -> int:
        line, n = lines[at], len(lines)
        indent = _indent(line)
        if indent >= 4:
            stop = at
            for k in range(at, n):
                if _indent(lines[k]) >= 4 and lines[k].strip(" \t"):
                    stop = k + 1
                elif lines[k].strip(" \t"):
                    break
            out.append(("code", None, "\n".join(_dedent(x, 4) for x in lines[at:stop])))
            return stop
        s = line.lstrip(" \t")
        if m := _ATX.match(s):
            raw = m[2] or ""
            out.append(("heading", len(m[1]), "" if re.fullmatch("#+", raw) else raw))
            return at + 1
        if m := _FENCE.match(s):
            mark, info = m[1] or m[3], _unescape((m[2] if m[1] else m[4]).strip())
            close = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
            body: list[str] = []
            at += 1
            while at < n and not close.match(lines[at]):
                body.append(_dedent(lines[at], min(indent, _indent(lines[at]))))
                at += 1
            out.append(("code", (info.split() or [""])[0] if info else None, "\n".join(body)))
            return at + 1 if at < n else at
        if _RULE.match(s):
            return at + 1
        if s.startswith(">") and depth < self.MAX_NESTING:
            inner: list[str] = []
            open_text = False
            while at < n:
                own = lines[at].lstrip(" \t")
                if own.startswith(">") and _indent(lines[at]) < 4:
                    inner.append(_dedent(own[1:], 1) if own[1:2] in (" ", "\t") else own[1:])
                    open_text = bool(inner[-1].strip(" \t"))
                elif open_text and own and not _interrupts(lines[at]):
                    inner.append(lines[at])
                else:
                    break
                at += 1
            out.append(("quote", self.blocks(inner, depth + 1)[0]))
            return at
        if (m := _BULLET.match(s)) and depth < self.MAX_NESTING:
            return self.list(lines, at, m, out, depth)
        if how := _html_start(s, False):
            while at < n:
                if how[0] is None and not lines[at].strip(" \t"):
                    break
                at += 1
                if how[0] is not None and how[0].search(lines[at - 1]):
                    break
            return at
        if at + 1 < n and "|" in line and _DELIMITER.match(lines[at + 1].strip(" \t")) and _indent(lines[at + 1]) < 4:
            header, under = _cells(line), _cells(lines[at + 1])
            if len(header) == len(under):
                rows = []
                at += 2
                while at < n and lines[at].strip(" \t") and not _interrupts(lines[at]):
                    row = _cells(lines[at])[: len(header)]
                    rows.append(row + [""] * (len(header) - len(row)))
                    at += 1
                out.append(("table", header, rows))
                return at
        return self.paragraph(lines, at, out)

    def paragraph(self, lines: list[str], at: int, out: list[tuple]) -> int:
        body = [lines[at].lstrip(" \t")]
        at += 1
        while at < len(lines) and lines[at].strip(" \t"):
            s = lines[at].lstrip(" \t")
            if _indent(lines[at]) < 4 and (m := _SETEXT.match(s)):
                if raw := self.define("\n".join(body)):
                    out.append(("heading", 1 if m[1][0] == "=" else 2, raw.strip(" \t\n")))
                    return at + 1
            if _interrupts(lines[at]):
                break
            body.append(s)
            at += 1
        raw = self.define("\n".join(body))
        if raw:
            out.append(("paragraph", raw.rstrip(" \t\n")))
        return at

    def define(self, raw: str) -> str:
        """Takes link definitions off the front."""
        while raw.startswith("[") and (m := _DEFINITION.match(raw)):
            if not _label(m[1]):
                break
            self.references.setdefault(_label(m[1]), _unescape(m[2][1:-1] if m[2].startswith("<") else m[2]))
            raw = raw[m.end() :].removeprefix("\n")
        return raw

    def list(self, lines: list[str], at: int, m: re.Match, out: list[tuple], depth: int) -> int:
        sign, n = m[1] or m[3], len(lines)
        items: list[list[tuple]] = []
        loose = False
        while at < n:
            s = lines[at].lstrip(" \t")
            own = _BULLET.match(s)
            if not own or (own[1] or own[3]) != sign or _indent(lines[at]) >= 4 or _RULE.match(s):
                break
            offset = _indent(lines[at]) + own.end()
            rest = s[own.end() :]
            pad = _indent(rest)
            empty = not rest.strip(" \t")
            width = offset + (1 if empty or pad > 4 else pad)
            body = ["" if empty else _dedent(" " * offset + rest, width)]
            at += 1
            open_text = not empty
            while at < n:
                x = lines[at]
                if not x.strip(" \t"):
                    if empty and len(body) == 1:
                        break
                    body.append("")
                    open_text = False
                elif _indent(x) >= width:
                    body.append(_dedent(x, width))
                    open_text = True
                elif open_text and not _interrupts(x) and not _BULLET.match(x.lstrip(" \t")):
                    body.append(x.lstrip(" \t"))
                else:
                    break
                at += 1
            tail = 0
            while len(body) > 1 and not body[-1]:
                body.pop()
                tail += 1
            nodes, spaced = self.blocks(body, depth + 1)
            items.append(nodes)
            loose |= spaced
            if empty and at < n and not lines[at].strip(" \t"):
                while at < n and not lines[at].strip(" \t"):
                    at, tail = at + 1, tail + 1
            if tail:
                following = _BULLET.match(lines[at].lstrip(" \t")) if at < n else None
                if not following or (following[1] or following[3]) != sign or _RULE.match(lines[at].lstrip(" \t")):
                    break
                loose = True
        out.append(("list", m[2] is not None, not loose, items))
        return at


class _Run:
    """A run of *, _ or ~ that may open or close emphasis."""

    __slots__ = ("char", "n", "whole", "opens", "closes")

    def __init__(self, char: str, n: int, before: str, after: str):
        self.char, self.n, self.whole = char, n, n
        mark = lambda c: bool(c) and not c.isalnum() and c not in WS
        space = lambda c: not c or c in WS
        left = not space(after) and (not mark(after) or space(before) or mark(before))
        right = not space(before) and (not mark(before) or space(after) or mark(after))
        if char == "_":
            self.opens, self.closes = left and (not right or mark(before)), right and (not left or mark(after))
        else:
            self.opens, self.closes = left, right
        if char == "~" and n > 2:
            self.opens = self.closes = False


def _emphasise(pieces: list) -> list[tuple]:
    """Spans of pieces in which runs are matched."""
    k = 0
    while k < len(pieces):
        close = pieces[k]
        if not isinstance(close, _Run) or not close.closes or not close.n:
            k += 1
            continue
        for j in range(k - 1, -1, -1):
            o = pieces[j]
            if not isinstance(o, _Run) or o.char != close.char or not o.opens or not o.n:
                continue
            if o.char == "~":
                if o.n != close.n:
                    continue
            elif (o.closes or close.opens) and (o.whole + close.whole) % 3 == 0 and (o.whole % 3 or close.whole % 3):
                continue
            break
        else:
            k += 1
            continue
        inner = _settle(pieces[j + 1 : k])
        used = o.n if o.char == "~" else 2 if min(o.n, close.n) >= 2 else 1
        made = inner if o.char == "~" else [("bold" if used == 2 else "italic", inner)]
        o.n -= used
        close.n -= used
        pieces[j + 1 : k] = made
        k = j + 1 + len(made)
        if not close.n:
            k += 1
    return _settle(pieces)


def _settle(pieces: list) -> list[tuple]:
    """Runs that found no partner are text; neighbouring texts join."""
    out: list[tuple] = []
    for p in pieces:
        p = ("text", p.char * p.n) if isinstance(p, _Run) else p
        if p[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + p[1])
        elif p[0] != "text" or p[1]:
            out.append(p)
    return out


_PLAIN = re.compile(r"[^\\`*_~\[\]!<&\n]+")
_DESTINATION = re.compile(r"<((?:[^<>\n\\]|\\.)*)>|((?:[^\s()\\\x00-\x1f]|\\.|\((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*\))+)")


class _Inline:
    def __init__(self, source: str, references: dict[str, str]):
        self.s, self.references = source, references
        self.images: list[tuple] = []
        self.pieces: list = []
        self.brackets: list[list] = []  # piece, whether image, active, position behind it
        self.missing: set[int] = set()  # lengths of backtick runs that have no partner ahead

    def parse(self) -> list[tuple]:
        s, at = self.s, 0
        while at < len(s):
            if m := _PLAIN.match(s, at):
                self.pieces.append(("text", m[0]))
                at = m.end()
            else:
                at = self.special(at)
        return _emphasise(self.pieces)

    def put(self, chars: str) -> None:
        self.pieces.append(("text", chars))

    def special(self, at: int) -> int:
        s, c = self.s, self.s[at]
        if c == "\\":
            following = s[at + 1 : at + 2]
            if following == "\n":
                self.pieces.append(("br",))
                return self.next_line(at + 2)
            if following and _ESCAPE.match(s, at):
                self.put(following)
                return at + 2
            self.put("\\")
            return at + 1
        if c == "\n":
            last = self.pieces[-1] if self.pieces else None
            hard = False
            if isinstance(last, tuple) and last[0] == "text":
                hard = last[1].endswith("  ")
                self.pieces[-1] = ("text", last[1].rstrip(" \t"))
            self.pieces.append(("br",) if hard else ("text", " "))
            return self.next_line(at + 1)
        if c == "`":
            n = len(re.compile("`+").match(s, at)[0])
            m = None if n in self.missing else re.compile(rf"(?<!`)`{{{n}}}(?!`)").search(s, at + n)
            if m is None:
                self.missing.add(n)
                self.put("`" * n)
                return at + n
            code = s[at + n : m.start()].replace("\n", " ")
            if len(code) > 2 and code[0] == code[-1] == " " and code.strip(" "):
                code = code[1:-1]
            self.pieces.append(("code", code))
            return m.end()
        if c in "*_~":
            n = 1
            while s[at + n : at + n + 1] == c:
                n += 1
            self.pieces.append(_Run(c, n, s[at - 1] if at else "", s[at + n : at + n + 1]))
            return at + n
        if c == "!" and s[at + 1 : at + 2] == "[" or c == "[":
            size = 2 if c == "!" else 1
            self.brackets.append([len(self.pieces), size == 2, True, at + size])
            self.put(s[at : at + size])
            return at + size
        if c == "]":
            return self.close(at)
        if c == "<":
            if m := _AUTOLINK.match(s, at):
                self.pieces.append(("link", m[1], [("text", m[1])]))
                return m.end()
            if m := _TAG.match(s, at) or _OTHER_HTML.match(s, at):
                return m.end()
        if c == "&" and (m := _ENTITY.match(s, at)):
            self.put(html.unescape(m[0]))
            return m.end()
        self.put(c)
        return at + 1

    def next_line(self, at: int) -> int:
        while self.s[at : at + 1] in (" ", "\t"):
            at += 1
        return at

    def close(self, at: int) -> int:
        s = self.s
        if not self.brackets:
            self.put("]")
            return at + 1
        place, image, active, begin = self.brackets.pop()
        found = self.target(at + 1, s[begin:at]) if active else None
        if found is None:
            self.put("]")
            return at + 1
        href, stop = found
        inner = _emphasise(self.pieces[place + 1 :])
        del self.pieces[place:]
        if image:
            alt = spans_plain(inner).strip(WS)
            self.images.append(("image", alt or None))
        else:
            self.pieces.append(("link", href, inner))
            for b in self.brackets:
                b[2] &= b[1]  # links don't hold links
        return stop

    def target(self, at: int, said: str) -> tuple[str, int] | None:
        s = self.s
        if s[at : at + 1] == "(":
            k = at + 1
            while s[k : k + 1] in (" ", "\t", "\n") and k < len(s):
                k += 1
            m = _DESTINATION.match(s, k)
            href, k = (m[1] if m[1] is not None else m[2], m.end()) if m else ("", k)
            if t := _TITLED.match(s, k):
                k = t.end()
            while k < len(s) and s[k] in " \t\n":
                k += 1
            if s[k : k + 1] == ")":
                return _unescape(href), k + 1
        m = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]", re.S).match(s, at)
        label = m[1] if m and m[1].strip() else said
        href = self.references.get(_label(label))
        return None if href is None else (href, m.end() if m else at)


class _Builder:
    def __init__(self, references: dict[str, str]):
        self.references, self.images = references, []

    def inline(self, raw: str) -> list[tuple]:
        i = _Inline(raw, self.references)
        spans = i.parse()
        self.images += i.images
        return spans

    def blocks(self, nodes: list[tuple], tight: bool = False, item: bool = False) -> list[tuple]:
        out: list[tuple] = []
        for k, node in enumerate(nodes):
            kind = node[0]
            if kind == "paragraph":
                raw, first = node[1], []
                if item and k == 0 and (m := re.match(r"\[([ xX])\][ \t\n]+(?=\S)", raw)):
                    raw, first = raw[m.end() :], text("[ ] " if m[1] == " " else "[x] ")
                spans = _settle(first + self.inline(raw))
                if spans_plain(spans).strip(WS):
                    out.append(("paragraph", spans))
                if not tight:
                    out += self.images
                    self.images = []
            elif kind == "heading":
                out.append(("heading", node[1], self.inline(node[2])))
            elif kind == "code":
                out.append(("code", node[1], node[2].rstrip(WS)))
            elif kind == "quote":
                out += self.blocks(node[1])
            elif kind == "list":
                out.append(("list", node[1], [self.blocks(i, node[2], True) for i in node[3]]))
            elif kind == "table":
                cells = lambda r: [self.inline(c) for c in r]
                out.append(("table", cells(node[1]), [cells(r) for r in node[2]]))
        return out


def parse(source: str) -> tuple[dict, list[tuple]]:
    """Metadata (title, from a leading heading of level 1) and blocks."""
    lines = source.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "�").split("\n")
    p = _Parser()
    nodes, _ = p.blocks(lines)
    blocks = _Builder(p.references).blocks(nodes)
    title = spans_plain(blocks[0][2]) if blocks and blocks[0][:2] == ("heading", 1) else None
    return {"title": title}, blocks
