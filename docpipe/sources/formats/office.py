"""Office Open XML and OpenDocument texts and presentations, and EPUB books, to blocks."""

from __future__ import annotations

import re

from ...functions.blocks import plain, spans_plain, styled, text
from ...functions.text import WS, py_resolve
from . import web
from .archive import Archive, Element, maybe_xml, parse_xml


def _table(rows: list[list[str]]) -> list[tuple]:
    """Cells as plain text; the first row is the header."""
    full = [[text(c.strip(WS)) for c in r] for r in rows if r]
    return [("table", full[0], full[1:])] if full else []


# ------------------------------------------------------ Office Open XML --

def core_properties(archive: Archive) -> dict:
    meta: dict = {}
    app = maybe_xml(archive.get("docProps/app.xml"))
    if app is not None:
        count = next((e for n in ("Pages", "Slides") if (e := app.find(n)) is not None), None)
        said = count.text().strip(WS) if count is not None else ""
        if re.fullmatch(r"\+?[0-9]+", said) and 0 < int(said) < 1 << 32:
            meta["page_count"] = int(said)
    core = maybe_xml(archive.get("docProps/core.xml"))
    if core is not None:
        meta |= {"title": core.said("title"), "author": core.said("creator"), "created": core.said("created"), "language": core.said("language")}
    return meta


def relationships(source: str | None) -> dict[str, str]:
    root = maybe_xml(source)
    found = root.find_all("Relationship") if root is not None else []
    return {r.attrs["Id"]: r.attrs["Target"] for r in found if "Id" in r.attrs and "Target" in r.attrs}


def numbering(source: str | None) -> dict[tuple[int, int], bool]:
    """(list id, level) to whether it is numbered, by way of the abstract definitions."""
    root = maybe_xml(source)
    if root is None:
        return {}
    abstract: dict[int, dict[int, bool]] = {}
    for d in root.find_all("abstractNum"):
        if (own := d.number("abstractNumId")) is None:
            continue
        for lvl in d.find_all("lvl"):
            fmt = lvl.child("numFmt")
            kind = fmt.attrs.get("val", "bullet") if fmt is not None else "bullet"
            abstract.setdefault(own, {})[min(8, max(0, lvl.number("ilvl") or 0))] = kind not in ("bullet", "none")
    out: dict[tuple[int, int], bool] = {}
    for n in root.find_all("num"):
        ref = n.child("abstractNumId")
        own, to = n.number("numId"), ref.number("val") if ref is not None else None
        if own is not None and to is not None:
            out |= {(own, level): kind for level, kind in abstract.get(to, {}).items()}
    return out


def _nest(items: list[tuple[int, bool, list[tuple]]], fixed: bool) -> tuple:
    """A list from (level, ordered, blocks) in order: deeper items go below the one before.
    fixed: levels count from the first item, else from each item."""
    out, k = [], 0
    while k < len(items):
        base = items[0][0] if fixed else items[k][0]
        end = k + 1
        while end < len(items) and items[end][0] > base:
            end += 1
        below = [_nest(items[k + 1 : end], fixed)] if end > k + 1 else []
        out.append(items[k][2] + below)
        k = end
    return "list", items[0][1], out


def _on(e: Element | None) -> bool:
    return e is not None and e.attrs.get("val") not in ("0", "false", "off")


class Docx:
    def __init__(self, archive: Archive):
        document = archive.need("word/document.xml")
        self.ordered = numbering(archive.get("word/numbering.xml"))
        self.links = relationships(archive.get("word/_rels/document.xml.rels"))
        root = parse_xml(document)
        body = root.child("body")
        self.result = self.blocks(root if body is None else body)

    def blocks(self, container: Element) -> list[tuple]:
        out: list[tuple] = []
        waiting: list[tuple[int, bool, list[tuple]]] = []

        def settle() -> None:
            if waiting:
                out.append(_nest(list(waiting), True))
                waiting.clear()

        for c in container.elements():
            if c.name == "p":
                item = self.list_item(c)
                if item is not None:
                    waiting.append(item)
                    continue
                settle()
                out += self.paragraph(c)
            elif c.name == "tbl":
                settle()
                out += _table([[" ".join(map(plain, self.blocks(tc))) for tc in tr.find_all("tc")] for tr in c.find_all("tr")])
        settle()
        return out

    def list_item(self, p: Element) -> tuple[int, bool, list[tuple]] | None:
        properties = p.child("pPr")
        num = properties.child("numPr") if properties is not None else None
        if num is None:
            return None
        value = lambda name: (e.number("val") if (e := num.child(name)) is not None else None) or 0
        level = min(8, max(0, value("ilvl")))
        return level, self.ordered.get((value("numId"), level), False), self.paragraph(p)

    def paragraph(self, p: Element) -> list[tuple]:
        spans, images = [], []
        self.inline(p, spans, images)
        out: list[tuple] = []
        if spans_plain(spans).strip(WS):
            level = _docx_level(p)
            out.append(("paragraph", spans) if level is None else ("heading", level, spans))
        return out + images

    def inline(self, e: Element, spans: list[tuple], images: list[tuple]) -> None:
        for c in e.elements():
            if c.name == "r":
                self.run(c, spans, images)
            elif c.name == "hyperlink":
                inner: list[tuple] = []
                self.inline(c, inner, images)
                href = self.links.get(c.attrs.get("id", ""))
                spans += [("link", href, inner)] if href is not None and inner else inner
            elif c.name in ("sdt", "sdtContent", "ins", "smartTag", "bookmarkStart", "fldSimple"):
                self.inline(c, spans, images)

    def run(self, r: Element, spans: list[tuple], images: list[tuple]) -> None:
        inner: list[tuple] = []
        for c in r.elements():
            if c.name == "t":
                inner += text(c.text())
            elif c.name in ("br", "cr"):
                inner.append(("br",))
            elif c.name in ("tab", "noBreakHyphen"):
                inner += text("\t" if c.name == "tab" else "-")
            elif c.name in ("drawing", "pict", "object"):
                about = c.find("docPr")
                if about is not None:
                    alt = about.attrs.get("descr", about.attrs.get("name", "")).strip(WS)
                    images.append(("image", alt or None))
        if inner:
            properties = r.child("rPr")
            bold, italic = (_on(properties.child(n)) if properties is not None else False for n in "bi")
            spans += styled(inner, bold, italic)


def _docx_level(p: Element) -> int | None:
    properties = p.child("pPr")
    if properties is None:
        return None
    style = properties.child("pStyle")
    name = style.attrs.get("val", "").lower() if style is not None else ""
    if (m := re.fullmatch(r"heading-*\+?([0-9]+)", name)) and 1 <= int(m[1]) <= 255:
        return min(6, int(m[1]))
    if name in ("title", "subtitle"):
        return 1 if name == "title" else 2
    outline = properties.child("outlineLvl")
    level = outline.number("val") if outline is not None else None
    return min(6, level + 1) if level is not None and 0 <= level <= 8 else None


def parse_docx(archive: Archive) -> tuple[dict, list[tuple]]:
    return core_properties(archive), Docx(archive).result


def _slide_spans(p: Element, links: dict[str, str]) -> list[tuple]:
    spans: list[tuple] = []
    for c in p.elements():
        t = c.child("t")
        said = text(t.text() if t is not None else "")
        if c.name == "r" and said:
            properties = c.child("rPr")
            flag = lambda n: properties is not None and properties.attrs.get(n, "0") not in ("0", "false")
            run = styled(said, flag("b"), flag("i"))
            click = properties.child("hlinkClick") if properties is not None else None
            href = links.get(click.attrs.get("id", "")) if click is not None else None
            spans += run if href is None else [("link", href, run)]
        elif c.name == "br":
            spans.append(("br",))
        elif c.name == "fld":
            spans += said
    return spans


def _slide_paragraphs(frame: Element, links: dict[str, str]) -> list[tuple[int, list[tuple]]]:
    out = []
    for p in frame.find_all("p"):
        properties = p.child("pPr")
        level = (properties.number("lvl") if properties is not None else None) or 0
        spans = _slide_spans(p, links)
        if spans_plain(spans).strip(WS):
            out.append((min(8, max(0, level)), spans))
    return out


def _slide(root: Element, number: int, links: dict[str, str]) -> list[tuple]:
    title, body = None, []
    for shape in root.find_all("sp"):
        frame = shape.find("txBody")
        found = _slide_paragraphs(frame, links) if frame is not None else []
        holder = shape.find("ph")
        if found and title is None and holder is not None and holder.attrs.get("type") in ("title", "ctrTitle"):
            title = found.pop(0)[1]
        body += found
    out: list[tuple] = [("page_break", number)] if number > 1 else []
    out.append(("heading", 2, text(f"Slide {number}") if title is None else title))
    if len(body) > 1:
        out.append(_nest([(level, False, [("paragraph", spans)]) for level, spans in body], False))
    else:
        out += [("paragraph", spans) for _, spans in body]
    for t in root.find_all("tbl"):
        out += _table([[" ".join(spans_plain(s) for _, s in _slide_paragraphs(tc, links)) for tc in tr.find_all("tc")] for tr in t.find_all("tr")])
    return out


def parse_pptx(archive: Archive) -> tuple[dict, list[tuple]]:
    names = [n for n in archive.under("ppt/slides/slide") if n.endswith(".xml")]
    blocks: list[tuple] = []
    for k, name in enumerate(names):
        folder, _, file = name.rpartition("/")
        links = relationships(archive.get(f"{folder}/_rels/{file}.rels"))
        blocks += _slide(parse_xml(archive.need(name)), k + 1, links)
    return core_properties(archive) | {"page_count": len(names)}, blocks


# --------------------------------------------------------- OpenDocument --

def odf_metadata(source: str | None) -> dict:
    root = maybe_xml(source)
    if root is None:
        return {}
    statistic = root.find("document-statistic")
    pages = statistic.number("page-count") if statistic is not None else None
    return {
        "title": root.said("title"), "author": root.said("creator") or root.said("initial-creator"),
        "created": root.said("creation-date"), "language": root.said("language"),
        "page_count": pages if pages and 0 < pages < 1 << 32 else None,
    }


class Odf:
    def __init__(self, root: Element):
        self.styles: dict[str, tuple[bool, bool]] = {}
        self.numbered: set[str] = set()
        for s in root.find_all("list-style"):
            level = next((x for x in s.elements() if x.name.startswith("list-level-style-")), None)
            if level is not None and level.name == "list-level-style-number" and "name" in s.attrs:
                self.numbered.add(s.attrs["name"])
        for s in root.find_all("style"):
            look = s.child("text-properties")
            if look is not None and "name" in s.attrs:
                weight = look.attrs.get("font-weight", "")
                bold = weight == "bold" or bool(re.fullmatch(r"\+?[0-9]+", weight)) and int(weight) >= 600
                italic = look.attrs.get("font-style") in ("italic", "oblique")
                if bold or italic:
                    self.styles[s.attrs["name"]] = bold, italic

    def blocks(self, container: Element) -> list[tuple]:
        out: list[tuple] = []
        for c in container.elements():
            if c.name in ("h", "p"):
                spans: list[tuple] = []
                self.inline(c, spans)
                if spans_plain(spans).strip(WS):
                    level = min(6, max(1, 1 if (n := c.number("outline-level")) is None else n))
                    out.append(("heading", level, spans) if c.name == "h" else ("paragraph", spans))
                if c.name == "p":
                    out += [_odf_image(f) for f in c.find_all("frame") if f.find("image") is not None]
            elif c.name == "list":
                items = [b for i in c.find_all("list-item") if (b := self.blocks(i))]
                if items:
                    out.append(("list", c.attrs.get("style-name", "") in self.numbered, items))
            elif c.name == "table":
                out += _table([[" ".join(map(plain, self.blocks(x))) for x in r.find_all("table-cell")] for r in c.find_all("table-row")])
            elif c.name in ("frame", "text-box", "section", "a", "soft-page-break"):
                out += self.blocks(c)
        return out

    def inline(self, e: Element, spans: list[tuple]) -> None:
        for c in e.children:
            if isinstance(c, str):
                spans += text(c)
            elif c.name in ("span", "a"):
                inner: list[tuple] = []
                self.inline(c, inner)
                if c.name == "span":
                    spans += styled(inner, *self.styles.get(c.attrs.get("style-name", ""), (False, False))) if inner else []
                else:
                    spans += [("link", c.attrs["href"], inner)] if inner and "href" in c.attrs else inner
            elif c.name == "line-break":
                spans.append(("br",))
            elif c.name == "tab":
                spans += text("\t")
            elif c.name == "s":
                spans += text(" " * min(64, max(1, 1 if (n := c.number("c")) is None else n)))
            elif c.name != "frame":
                self.inline(c, spans)

    def pages(self, presentation: Element) -> list[tuple]:
        out: list[tuple] = []
        for k, page in enumerate(presentation.find_all("page")):
            number = k + 1
            own = self.blocks(page)
            if own and own[0][0] == "paragraph":
                title = own.pop(0)[1]
            else:
                title = text(page.attrs.get("name", f"Slide {number}"))
            out += ([("page_break", number)] if k else []) + [("heading", 2, title), *own]
        return out


def _odf_image(frame: Element) -> tuple:
    about = frame.find("desc")
    if about is None:
        about = frame.find("title")
    said = about.text().strip(WS) if about is not None else ""
    return "image", said or frame.attrs.get("name")


def parse_odf(archive: Archive) -> tuple[dict, list[tuple]]:
    root = parse_xml(archive.need("content.xml"))
    meta = odf_metadata(archive.get("meta.xml"))
    body, odf = root.child("body"), Odf(root)
    if body is None:
        return meta, []
    presentation, written = body.child("presentation"), body.child("text")
    if presentation is not None:
        return meta, odf.pages(presentation)
    return meta, odf.blocks(body if written is None else written)


# ----------------------------------------------------------------- EPUB --

def parse_epub(archive: Archive) -> tuple[dict, list[tuple]]:
    """Chapters in the order of the spine; one that is missing is passed over."""
    files = parse_xml(archive.need("META-INF/container.xml")).find_all("rootfile")
    path = next((f.attrs["full-path"] for f in files if "full-path" in f.attrs), None)
    if path is None:
        raise ValueError("container.xml names no package")
    root = parse_xml(archive.need(path))
    about, manifest, spine = root.child("metadata"), root.child("manifest"), root.child("spine")
    meta = {} if about is None else {"title": about.said("title"), "author": about.said("creator"), "created": about.said("date"), "language": about.said("language"), "publisher": about.said("publisher")}
    places: dict[str, str] = {}
    for item in manifest.find_all("item") if manifest is not None else []:
        if "id" in item.attrs and "href" in item.attrs:
            places.setdefault(item.attrs["id"], item.attrs["href"])
    base = path[: path.rfind("/") + 1]
    blocks: list[tuple] = []
    for ref in spine.find_all("itemref") if spine is not None else []:
        href = places.get(ref.attrs.get("idref", ""))
        if ref.attrs.get("linear") == "no" or href is None:
            continue
        source = archive.get(py_resolve(base, href))
        if source is None:
            continue
        page, own = web.parse(source)
        if own and own[0][0] != "heading" and page["title"]:
            own.insert(0, ("heading", 1, text(page["title"])))
        blocks += own
    return meta, blocks
