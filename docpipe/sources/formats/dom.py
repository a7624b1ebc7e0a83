"""HTML text to a tree, by the construction rules of the HTML standard that matter for content:
implied html, head and body, implied ends, re-opened formatting elements, the adoption agency,
foster parenting out of tables, raw text elements. The tree is at most MAX_DEPTH levels deep;
what is nested further becomes a sibling."""

from __future__ import annotations

import html
import re

MAX_DEPTH = 400
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul pre listing form hr xmp plaintext table".split()) | HEADINGS
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split()
) | HEADINGS
SCOPE = frozenset("applet caption html table td th marquee object template".split())
BUTTON_SCOPE, LIST_SCOPE, TABLE_SCOPE = SCOPE | {"button"}, SCOPE | {"ol", "ul"}, frozenset({"html", "table", "template"})
MARKER_TAGS = frozenset("applet marquee object td th caption template".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes script style template title noscript".split())
RAW_TEXT, RC_DATA = frozenset("script style xmp iframe noembed noframes noscript".split()), frozenset("title textarea".split())
TABLE_PARTS = frozenset("table tbody tfoot thead tr".split())
SECTIONS = frozenset("tbody thead tfoot".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([^\s=>/][^\s=>/]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.S)


class Node:
    """An element with its children in order; a child that is a string is text."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], None

    def append(self, child: Node | str) -> None:
        self.insert(len(self.children), child)

    def insert(self, at: int, child: Node | str) -> None:
        if isinstance(child, str):
            if at and isinstance(self.children[at - 1], str):
                self.children[at - 1] += child
                return
        else:
            child.detach()
            child.parent = self
            # Detaching may have moved later children down.
            at = min(at, len(self.children))
        self.children.insert(at, child)

    def detach(self) -> None:
        if self.parent is not None:
            siblings = self.parent.children
            del siblings[next(k for k in range(len(siblings) - 1, -1, -1) if siblings[k] is self)]
            self.parent = None

    def twin(self) -> Node:
        return Node(self.tag, dict(self.attrs))


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        value = next((v for v in m.groups()[1:] if v is not None), "")
        out.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
    return out


class Builder:
    def __init__(self):
        self.document = Node("#document")
        self.html = self.head = self.body = None
        self.stack: list[Node] = []
        self.active: list[Node | None] = []  # None is a marker
        self.after_head = False
        self.skip_newline = False

    # -- the stack --

    @property
    def current(self) -> Node:
        return self.stack[-1] if self.stack else self.document

    def in_scope(self, tags: str | frozenset, stops: frozenset = SCOPE) -> bool:
        wanted = {tags} if isinstance(tags, str) else tags
        for node in reversed(self.stack):
            if node.tag in wanted:
                return True
            if node.tag in stops:
                return False
        return False

    def pop_to(self, tags: str | frozenset) -> None:
        wanted = {tags} if isinstance(tags, str) else tags
        while self.stack and self.stack.pop().tag not in wanted:
            pass

    def imply_ends(self, but: str = "") -> None:
        while self.stack and self.current.tag in IMPLIED and self.current.tag != but:
            self.stack.pop()

    def close_p(self) -> None:
        if self.in_scope("p", BUTTON_SCOPE):
            self.imply_ends("p")
            self.pop_to("p")

    def clear_to(self, tags: frozenset) -> None:
        while self.stack and self.current.tag not in tags:
            self.stack.pop()

    def clear_markers(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    # -- insertion --

    def place(self) -> tuple[Node, int]:
        """Where the next node goes; in the midst of a table, before the table."""
        target = self.current
        if target.tag in TABLE_PARTS and self.fostering:
            for k in range(len(self.stack) - 1, -1, -1):
                node = self.stack[k]
                if node.tag == "template":
                    return node, len(node.children)
                if node.tag == "table":
                    if node.parent is not None:
                        return node.parent, next(j for j, c in enumerate(node.parent.children) if c is node)
                    return self.stack[k - 1], len(self.stack[k - 1].children)
        return target, len(target.children)

    fostering = False

    def add(self, node: Node, push: bool = True) -> Node:
        parent, at = self.place()
        parent.insert(at, node)
        if push and len(self.stack) < MAX_DEPTH:
            self.stack.append(node)
        return node

    def add_text(self, text: str) -> None:
        parent, at = self.place()
        parent.insert(at, text)

    def reopen(self) -> None:
        """Formatting elements that were closed by force open again."""
        k = len(self.active)
        while k and self.active[k - 1] is not None and self.active[k - 1] not in self.stack:
            k -= 1
        for j in range(k, len(self.active)):
            self.active[j] = self.add(self.active[j].twin())

    def remember(self, node: Node) -> None:
        same = 0
        for k in range(len(self.active) - 1, -1, -1):
            other = self.active[k]
            if other is None:
                break
            if other.tag == node.tag and other.attrs == node.attrs:
                same += 1
                if same == 3:  # three alike at most
                    del self.active[k]
                    break
        self.active.append(node)

    def _at(self, nodes: list, node: Node) -> int:
        return next((k for k, x in enumerate(nodes) if x is node), -1)

    def adopt(self, tag: str) -> bool:
        """An end tag of a formatting element; False if it is one like any other."""
        if self.current.tag == tag and self._at(self.active, self.current) < 0:
            self.stack.pop()
            return True
        for _ in range(8):
            own = None
            for node in reversed(self.active):
                if node is None:
                    break
                if node.tag == tag:
                    own = node
                    break
            if own is None:
                return False
            at = self._at(self.stack, own)
            if at < 0:
                self.active.remove(own)
                return True
            if not self.in_scope(tag):
                return True
            block = next((k for k in range(at + 1, len(self.stack)) if self.stack[k].tag in SPECIAL), None)
            if block is None:
                del self.stack[at:]
                self.active.remove(own)
                return True
            furthest, ancestor = self.stack[block], self.stack[at - 1]
            mark = Node("#mark")  # where the copy will stand among the active ones
            self.active.insert(self._at(self.active, own), mark)
            last, k, inner = furthest, block, 0
            while True:
                inner += 1
                k -= 1
                node = self.stack[k]
                if node is own:
                    break
                place = self._at(self.active, node)
                if inner > 3 and place >= 0:
                    del self.active[place]
                    place = -1
                if place < 0:
                    del self.stack[k]
                    continue
                copy = node.twin()
                self.active[place] = self.stack[k] = copy
                if last is furthest:
                    self.active.remove(mark)
                    self.active.insert(self._at(self.active, copy) + 1, mark)
                copy.append(last)
                last = copy
            if ancestor.tag in TABLE_PARTS:
                held, self.stack, self.fostering = self.stack, self.stack[:at], True
                last.detach()
                parent, spot = self.place()
                self.stack, self.fostering = held, False
                parent.insert(spot, last)
            else:
                ancestor.append(last)
            copy = own.twin()
            for child in furthest.children:
                if isinstance(child, Node):
                    child.parent = copy
            copy.children, furthest.children = furthest.children, []
            furthest.append(copy)
            self.active.remove(own)
            self.active[self._at(self.active, mark)] = copy
            self.stack.remove(own)
            self.stack.insert(self._at(self.stack, furthest) + 1, copy)
        return True

    # -- phases --

    def need_html(self, attrs: dict | None = None) -> None:
        if self.html is None:
            self.html = Node("html", attrs)
            self.document.append(self.html)
            self.stack = [self.html]
        elif attrs:
            for k, v in attrs.items():
                self.html.attrs.setdefault(k, v)

    def need_head(self) -> None:
        self.need_html()
        if self.head is None:
            self.head = Node("head")
            self.html.append(self.head)

    def need_body(self, attrs: dict | None = None) -> None:
        self.need_head()
        if self.body is None:
            self.body = Node("body", attrs)
            self.html.append(self.body)
            self.stack = [self.html, self.body]
        elif attrs:
            for k, v in attrs.items():
                self.body.attrs.setdefault(k, v)

    def characters(self, text: str) -> None:
        if self.skip_newline:
            self.skip_newline = False
            text = text.removeprefix("\n")
        if not text:
            return
        if self.body is None:
            if not text.strip(" \t\n\r\f"):
                return
            self.need_body()
            text = text.lstrip(" \t\n\r\f")
        if self.current.tag in TABLE_PARTS:
            if not text.strip(" \t\n\r\f"):
                self.current.append(text)
                return
            self.fostering = True
            self.reopen()
            self.add_text(text)
            self.fostering = False
            return
        self.reopen()
        self.add_text(text)

    def raw(self, tag: str, attrs: dict, text: str) -> None:
        """An element whose content is text."""
        node = Node(tag, attrs)
        if self.body is None and tag in HEAD_TAGS:
            self.need_head()
            self.head.append(node)
        else:
            self.need_body()
            if tag == "xmp":
                self.close_p()
                self.reopen()
            self.fostering = self.current.tag in TABLE_PARTS and tag not in ("script", "style")
            self.add(node, push=False)
            self.fostering = False
        if text:
            node.append(text)

    def start(self, tag: str, attrs: dict) -> None:
        self.skip_newline = False
        if tag == "html":
            self.need_html(attrs)
            return
        if tag == "head":
            if self.body is None:
                self.need_head()
                self.head.attrs.update(attrs)
            return
        if self.body is None and tag in HEAD_TAGS:
            self.need_head()
            if tag in VOID:
                self.head.append(Node(tag, attrs))
                return
        if tag == "body":
            self.need_body(attrs)
            return
        if tag in ("frameset", "frame"):
            return
        self.need_body()
        if self.in_table() and self.table_start(tag, attrs):
            return
        self.fostering = self.current.tag in TABLE_PARTS
        self.body_start(tag, attrs)
        self.fostering = False

    def in_table(self) -> bool:
        """Whether table rules come first: a table is open and no cell or caption within it."""
        near = next((n.tag for n in reversed(self.stack) if n.tag in ("td", "th", "caption", "template", "table")), "")
        return near == "table"

    def open_cell(self) -> bool:
        return self.in_scope(frozenset({"td", "th"}), TABLE_SCOPE)

    def close_cell(self) -> None:
        self.imply_ends()
        self.pop_to(frozenset({"td", "th"}))
        self.clear_markers()

    def table_start(self, tag: str, attrs: dict) -> bool:
        if tag == "caption":
            self.clear_to(TABLE_SCOPE)
            self.active.append(None)
            self.add(Node(tag, attrs))
        elif tag in ("col", "colgroup"):
            self.clear_to(TABLE_SCOPE | ({"colgroup"} if tag == "col" else frozenset()))
            self.add(Node(tag, attrs), push=False)
        elif tag in SECTIONS:
            self.clear_to(TABLE_SCOPE)
            self.add(Node(tag, attrs))
        elif tag == "tr":
            self.clear_to(TABLE_SCOPE | SECTIONS)
            if self.current.tag == "table":
                self.add(Node("tbody"))
            self.add(Node(tag, attrs))
        elif tag in ("td", "th"):
            if not self.in_scope("tr", TABLE_SCOPE):
                self.table_start("tr", {})
            self.clear_to(frozenset({"tr", "html", "template"}))
            self.add(Node(tag, attrs))
            self.active.append(None)
        elif tag == "table":
            self.end("table")
            self.start(tag, attrs)
        elif tag == "input" and attrs.get("type", "").lower() == "hidden":
            self.add(Node(tag, attrs), push=False)
        else:
            return False
        return True

    def body_start(self, tag: str, attrs: dict) -> None:
        if tag in ("caption", "col", "colgroup", "td", "th", "tr") or tag in SECTIONS:
            # In a cell these end it; elsewhere they mean nothing.
            if self.in_scope("table", TABLE_SCOPE):
                if self.open_cell():
                    self.close_cell()
                elif self.in_scope("caption", TABLE_SCOPE):
                    self.pop_to("caption")
                    self.clear_markers()
                else:
                    return
                self.start(tag, attrs)
            return
        if tag in CLOSES_P:
            self.close_p()
            if tag in HEADINGS and self.current.tag in HEADINGS:
                self.stack.pop()
            if tag == "hr":
                self.add(Node(tag, attrs), push=False)
                return
            self.add(Node(tag, attrs))
            self.skip_newline = tag in ("pre", "listing")
            return
        if tag in ("li", "dd", "dt"):
            ends = {"li"} if tag == "li" else {"dd", "dt"}
            for node in reversed(self.stack):
                if node.tag in ends:
                    self.imply_ends(node.tag)
                    self.pop_to(node.tag)
                    break
                if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                    break
            self.close_p()
            self.add(Node(tag, attrs))
            return
        if tag == "a":
            for node in reversed(self.active):
                if node is None:
                    break
                if node.tag == "a":
                    self.adopt("a")
                    if self._at(self.active, node) >= 0:
                        self.active.remove(node)
                    if self._at(self.stack, node) >= 0:
                        self.stack.remove(node)
                    break
        if tag == "nobr" and self.in_scope("nobr"):
            self.reopen()
            self.adopt("nobr")
        if tag == "button" and self.in_scope("button"):
            self.imply_ends()
            self.pop_to("button")
        if tag in ("option", "optgroup"):
            if self.current.tag == "option":
                self.stack.pop()
            if tag == "optgroup" and self.current.tag == "optgroup":
                self.stack.pop()
        if tag in ("rb", "rtc", "rp", "rt") and self.in_scope("ruby"):
            self.imply_ends("rtc" if tag in ("rp", "rt") else "")
        if tag == "image":
            tag = "img"
        self.reopen()
        node = self.add(Node(tag, attrs), push=tag not in VOID)
        if tag in FORMATTING:
            self.remember(node)
        elif tag in MARKER_TAGS:
            self.active.append(None)

    def end(self, tag: str) -> None:
        self.skip_newline = False
        if tag in ("html", "body", "head"):
            return
        if self.body is None:
            if tag == "br":
                self.start("br", {})
            return
        if tag == "br":
            self.start("br", {})
            return
        if tag == "p":
            if not self.in_scope("p", BUTTON_SCOPE):
                self.fostering = self.current.tag in TABLE_PARTS
                self.add(Node("p"))
                self.fostering = False
            self.close_p()
            return
        if tag in FORMATTING:
            if self.adopt(tag):
                return
        elif tag in ("td", "th"):
            if self.in_scope(tag, TABLE_SCOPE):
                self.imply_ends()
                self.pop_to(tag)
                self.clear_markers()
            return
        elif tag == "caption":
            if self.in_scope(tag, TABLE_SCOPE):
                self.pop_to(tag)
                self.clear_markers()
            return
        elif tag in TABLE_PARTS:
            if self.in_scope(tag, TABLE_SCOPE):
                if self.open_cell() and self._cell_above(tag):
                    self.close_cell()
                self.pop_to(tag)
            return
        elif tag in ("li", "dd", "dt"):
            if self.in_scope(tag, LIST_SCOPE if tag == "li" else SCOPE):
                self.imply_ends(tag)
                self.pop_to(tag)
            return
        elif tag in HEADINGS:
            if self.in_scope(HEADINGS):
                self.imply_ends()
                self.pop_to(HEADINGS)
            return
        elif tag in CLOSES_P or tag in ("button",) or tag in MARKER_TAGS:
            if self.in_scope(tag):
                self.imply_ends()
                self.pop_to(tag)
                if tag in MARKER_TAGS:
                    self.clear_markers()
            return
        for k in range(len(self.stack) - 1, -1, -1):
            node = self.stack[k]
            if node.tag == tag:
                self.imply_ends(tag)
                k = self._at(self.stack, node)
                if k >= 0:
                    del self.stack[k:]
                return
            if node.tag in SPECIAL:
                return

    def _cell_above(self, tag: str) -> bool:
        for node in reversed(self.stack):
            if node.tag in ("td", "th"):
                return True
            if node.tag == tag:
                return False
        return False


def parse(source: str) -> Node:
    """The document node."""
    source = source.replace("\r\n", "\n").replace("\r", "\n").removeprefix("﻿")
    b = Builder()
    at, end = 0, len(source)
    while at < end:
        lt = source.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            piece = source[at:lt]
            b.characters((html.unescape(piece) if "&" in piece else piece).replace("\0", ""))
            at = lt
            continue
        if source.startswith("<!--", at):
            stop = at + 4 + source[at + 4 : at + 6].startswith(">") if source.startswith((">", "->"), at + 4) else -1
            if stop >= 0:
                at = source.index(">", at + 4) + 1
            else:
                stop = source.find("-->", at + 4)
                at = stop + 3 if stop >= 0 else end
            continue
        if source.startswith(("<!", "<?"), at) or source.startswith("</", at) and not source[at + 2 : at + 3].isalpha():
            stop = source.find(">", at)
            at = stop + 1 if stop >= 0 else end
            continue
        m = _TAG.match(source, at)
        if m is None:
            if source[at + 1 : at + 2].isalpha() and source[at + 1].isascii() or source.startswith("</", at):
                break  # a tag that never ends takes the rest with it
            b.characters("<")
            at += 1
            continue
        at = m.end()
        slash, tag, attrs = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
        tag = tag.lower()
        if slash:
            b.end(tag)
            continue
        found = _attributes(attrs) if attrs else {}
        if tag in RAW_TEXT or tag in RC_DATA:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            text = source[at : stop.start() if stop else end]
            if tag in RC_DATA:
                text = html.unescape(text)
            if tag == "textarea":
                text = text.removeprefix("\n")
            b.raw(tag, found, text)
            if stop:
                gt = source.find(">", stop.end())
                at = gt + 1 if gt >= 0 else end
            else:
                at = end
            continue
        if tag == "plaintext":
            b.start(tag, found)
            b.characters(source[at:])
            break
        b.start(tag, found)
    b.need_body()
    return b.document
