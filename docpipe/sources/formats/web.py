"""HTML to blocks. Menus, forms and media are dropped, containers are transparent, and what
stands loose between blocks becomes paragraphs."""

from __future__ import annotations

from ...functions.blocks import text, trim_spans
from ...functions.text import WS, py_squeeze
from .dom import HEADINGS, Node, parse as parse_dom

DROPPED = frozenset("aside audio button canvas embed footer form iframe input nav noscript object script select style svg template textarea video".split())
INLINE = frozenset("strong small abbr cite code mark samp span time del ins kbd sub sup var em tt a b i q s u".split())
STYLES = {"strong": "bold", "b": "bold", "em": "italic", "i": "italic"}
CODE = frozenset("code kbd samp tt var".split())


class _Page:
    def __init__(self):
        self.title = self.author = self.language = None


def _content(node: Node) -> str:
    """All text below, as it stands."""
    return "".join(c if isinstance(c, str) else "" if c.tag in DROPPED else _content(c) for c in node.children)


def _alt(node: Node) -> str:
    return node.attrs.get("alt", "").strip(WS)


def _inline(node: Node) -> list[tuple]:
    spans: list[tuple] = []
    for c in node.children:
        if isinstance(c, str):
            spans += text(py_squeeze(c))
        elif c.tag in DROPPED:
            continue
        elif c.tag in STYLES:
            if inner := trim_spans(_inline(c)):
                spans.append((STYLES[c.tag], inner))
        elif c.tag in CODE:
            if code := _content(c).strip(WS):
                spans.append(("code", code))
        elif c.tag == "a":
            inner, href = _inline(c), c.attrs.get("href", "").strip(WS)
            spans += [("link", href, inner)] if href and inner else inner
        elif c.tag == "br":
            spans.append(("br",))
        elif c.tag == "img":
            spans += text(_alt(c))
        else:
            spans += _inline(c)
    return spans


def _language(pre: Node) -> str | None:
    holder = pre if "class" in pre.attrs else next((c for c in pre.children if isinstance(c, Node) and c.tag == "code"), pre)
    for name in holder.attrs.get("class", "").split():
        for start in ("language-", "lang-"):
            if name.startswith(start):
                return name.removeprefix(start)
    return None


def _rows(node: Node) -> list[Node]:
    out = []
    for c in node.children:
        if isinstance(c, Node):
            if c.tag == "tr":
                out.append(c)
            elif c.tag in ("thead", "tbody", "tfoot"):
                out += _rows(c)
    return out


def _table(node: Node) -> list[tuple]:
    header, rows = None, []
    for row in _rows(node):
        kinds = [c for c in row.children if isinstance(c, Node) and c.tag in ("th", "td")]
        cells = [trim_spans(_inline(c)) for c in kinds]
        if not cells:
            continue
        if header is None and all(c.tag == "th" for c in kinds):
            header = cells
        else:
            rows.append(cells)
    return [("table", header, rows)] if header is not None or rows else []


class _Walker:
    def __init__(self, page: _Page):
        self.page, self.blocks, self.loose = page, [], []

    def flush(self) -> None:
        spans, self.loose = trim_spans(self.loose), []
        if spans:
            self.blocks.append(("paragraph", spans))

    def put(self, *blocks: tuple) -> None:
        if blocks:
            self.flush()
            self.blocks += blocks

    def walk(self, node: Node) -> _Walker:
        for c in node.children:
            if isinstance(c, str):
                self.loose += text(py_squeeze(c))
            elif c.tag not in DROPPED:
                self.element(c)
        return self

    def element(self, c: Node) -> None:
        tag, page = c.tag, self.page
        if tag == "title":
            page.title = page.title or _content(c).strip(WS) or None
        elif tag == "meta":
            if c.attrs.get("name", "").lower() == "author":
                page.author = c.attrs.get("content", "").strip(WS) or None
        elif tag in HEADINGS:
            if spans := trim_spans(_inline(c)):
                self.put(("heading", int(tag[1]), spans))
        elif tag == "p":
            self.flush()
            if spans := trim_spans(_inline(c)):
                self.blocks.append(("paragraph", spans))
        elif tag == "br":
            self.loose.append(("br",))
        elif tag == "hr":
            self.flush()
        elif tag == "pre":
            code = _content(c)
            if code.strip(WS):
                self.put(("code", _language(c), code.strip("\n")))
        elif tag in ("ul", "ol"):
            items = [_Walker(page).walk(li).done() for li in c.children if isinstance(li, Node) and li.tag == "li"]
            if items := [i for i in items if i]:
                self.put(("list", tag == "ol", items))
        elif tag == "table":
            self.put(*_table(c))
        elif tag == "img":
            if alt := _alt(c):
                self.put(("image", alt))
        elif tag in INLINE:
            # A loose inline element gives its content; its own style belongs to blocks only.
            self.loose += _inline(c)
        else:
            if tag == "html":
                page.language = c.attrs.get("lang", "").strip(WS) or None
            self.flush()
            self.walk(c)
            self.flush()

    def done(self) -> list[tuple]:
        self.flush()
        return self.blocks


def parse(source: str) -> tuple[dict, list[tuple]]:
    """Metadata (title, author, language) and blocks."""
    page = _Page()
    blocks = _Walker(page).walk(parse_dom(source)).done()
    return {"title": page.title, "author": page.author, "language": page.language}, blocks
