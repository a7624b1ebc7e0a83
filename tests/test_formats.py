"""Parsers and renderers on small files of each format."""

from __future__ import annotations

import pytest
from hypothesis import given, settings, strategies as st
from samples import ALL, docx, epub, odt, pdf, zipped

from docpipe.functions import blocks as B, text as T, values as V
from docpipe.sources import formats
from docpipe.sources.formats import archive, dom, markdown, pagelayout, pdf as P, plain, sheet, web


def rendered(blocks: list[tuple]) -> str:
    return "\n\n".join(m for m in (B.md(b).rstrip(T.WS) for b in blocks) if m) + "\n"


@pytest.mark.parametrize("name", ALL)
def test_every_format(name):
    raw, shown, kind = ALL[name]
    _, blocks = formats.extract(kind, raw)
    assert rendered(blocks) == shown
    assert [B.from_json(B.to_json(b)) for b in blocks] == blocks
    assert all(B.tokens(B.spans_of(r["spans"])) == r["spans"] for r in B.flat(blocks) if r["spans"])


def test_metadata():
    assert formats.extract("docx", docx())[0] == {"page_count": 3, "title": "Annual Plan", "author": "Grace H.", "created": "2023-05-01T10:00:00Z", "language": "en-GB"}
    assert formats.extract("odt", odt())[0]["author"] == "Ida"
    assert formats.extract("epub", epub())[0]["publisher"] == "House"
    assert formats.extract("html", ALL["a.html"][0])[0] == {"title": "T", "author": "Ada", "language": "en"}
    assert formats.extract("rtf", ALL["a.rtf"][0])[0] == {"title": "A é", "author": "Me", "created": "2021-03-09"}
    assert formats.extract("pdf", ALL["i.pdf"][0])[0] == {"page_count": 1, "title": "Report", "author": "A. B.", "created": "2024-01-31"}
    assert formats.extract("markdown", b"# T\n")[0] == {"title": "T"}


@pytest.mark.parametrize(("kind", "raw", "reason"), [
    ("docx", b"PK\x03\x04no", "parse_error"), ("docx", zipped({"word/x.xml": ""}), "parse_error"), ("docx", zipped({"word/document.xml": "<a><b>"}), "parse_error"),
    ("epub", zipped({"META-INF/container.xml": "<c/>"}), "parse_error"), ("pdf", b"%PDF-1.4 nothing", "parse_error"), ("pdf", b"text", "parse_error"), ("pdf", pdf([[]]), "no_text_layer"),
    ("rtf", b"plain", "parse_error"), ("csv", b"a,\xff\n", "parse_error"), ("csv", b"", "no_text_layer"), ("txt", b" \n\n", "no_text_layer"), (None, b"x", "unsupported_format"), ("html", b"", "no_text_layer"),
    ("xlsx", zipped({"xl/workbook.xml": "<w><sheets/></w>"}), "no_text_layer"), ("pptx", zipped({"ppt/x": ""}), "no_text_layer"), ("txt", b"\xff\xfe ok", None),
])
def test_failures(kind, raw, reason):
    if reason is None:
        formats.extract(kind, raw)
        return
    with pytest.raises(formats.Failure) as e:
        formats.extract(kind, raw)
    assert e.value.reason == reason


HTML_CASES = [
    ("<li><b>x</b></li>", "x"), ("<p>a<p>b", "a\n\nb"), ("<p><b>1<p>2", "**1**\n\n**2**"), ("<p>1<b>2<i>3</b>4</i>5", "1**2*3****4*5"), ("<div>a<div>b</div>c</div>", "a\n\nb\n\nc"),
    ("<table>x<tr><td>y</table>", "x\n\n|     |\n| --- |\n| y   |"), ("<ul><ul><li>lost</ul><li>kept</ul>", "- kept"), ("<form>f</form><header>h</header>", "h"), ("<p>a<br>b<br></p>", "a  \nb"),
    ("<p><code>`x`</code>", "`` `x` ``"), ("<p>&lt;i&gt; &copy", "\\<i> ©"), ("a<hr>b", "a\n\nb"), ("<h2> </h2>x", "x"), ("<p>snake_case _x_", "snake_case \\_x\\_"), ("<p># no", "\\# no"), ("<p>1. no", "\\1. no"),
    ("<p><a href='a(b'>t</a>", "[t](<a(b>)"), ("<p>a<script>x</script>b", "ab"), ("<title>a</title><title>b</title>c", "c"), ("<p>a<!-- c -->b", "ab"), ("<dl><dt>a<dd>b</dl>", "a\n\nb"), ("<select><option>x</select>y", "y"),
    ("<p>a<a href=u>1<a href=v>2", "a[1](u)[2](v)"), ("<pre>\n\na\n</pre>", "```\na\n```"), ("<table><tr><td><p>a<td>b</table>c", "|     |     |\n| --- | --- |\n| a   | b   |\n\nc"), ("x < y", "x \\< y"),
]


@pytest.mark.parametrize(("source", "shown"), HTML_CASES)
def test_html(source, shown):
    assert rendered(web.parse(source)[1]) == shown + "\n"


MARKDOWN_CASES = [
    ("a *b* **c** ***d***", "a *b* **c** ***d***"), ("a_b_c _d_", "a_b_c *d*"), ("**a*", "\\**a*"), ("`a``b`", "```a``b```"), ("[t](<u v> 'x')", "[t](<u v>)"), ("<https://e.org>", "[https://e.org](https://e.org)"),
    ("- a\n- b\n\n- c", "- a\n- b\n- c"), ("- a\n  b\n\n  c", "- a b\n\n  c"), ("* a\n\n+ b", "- a\n\n- b"), ("1) a\n2) b", "1. a\n2. b"), ("a\n---\nb", "## a\n\nb"), ("---\n", ""), ("<div>\nx\n</div>\n\ny", "y"), ("a  \nb", "a  \nb"), ("a\\\nb", "a  \nb"),
    ("~~~\ncode\n~~~", "```\ncode\n```"), ("> a\n> - b\nc", "a\n\n- b c"), ("\\*a\\*", "\\*a\\*"), ("&amp; &#65;", "& A"), ("| a |\n| - |\n| b\\|c |", "| a    |\n| ---- |\n| b\\|c |"), ("![x](u)", "![x]()"), ("a ![x](u) b\n\nc", "a  b\n\n![x]()\n\nc"),
    ("[a]\n\n[a]: b", "[a](b)"), ("# a #", "# a"), ("####### a", "\\####### a"), ("    x\n\n    y", "```\nx\n\ny\n```"), ("- a\n\n      code", "- a\n\n  ```\n  code\n  ```"), ("[x](y[z])", "[x](y[z])"),
]


@pytest.mark.parametrize(("source", "shown"), MARKDOWN_CASES)
def test_markdown(source, shown):
    assert rendered(markdown.parse(source)[1]) == shown + "\n"


def test_markdown_round_trip():
    source = "# H\n\ntext *a* **b** [c](d)\n\n- x\n  1. y\n- z\n\n| a   | b   |\n| --- | --- |\n| 1   | 2   |\n\n```py\nx\n```\n"
    assert rendered(markdown.parse(source)[1]) == source


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab*_`[]()<>!&#-+|>\\~ \n\t1.é:/\"'", max_size=80))
def test_markdown_and_html_never_fail(source):
    markdown.parse(source)
    web.parse(source)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("<p> </p> <b> </b> <i> </i> <a> </a> <table> </table> <tr> <td> </td> <div> </div> <ul> <li> </ul> <h1> </h1> x <br> <button> </button> <select> <option> </select> <caption> </tr>".split()), max_size=40))
def test_tree_keeps_all_text(tags):
    source = "".join(tags)
    count = lambda n: sum(c.count("x") if isinstance(c, str) else count(c) for c in n.children)
    assert count(dom.parse(source)) == source.count("x")


def test_hostile_inputs():
    assert len(web.parse("<div>" * 20000 + "x")[1]) == 1
    assert web.parse("<b>" * 2000 + "x" + "<p>y" * 50)[1]
    markdown.parse("> " * 5000 + "x")
    markdown.parse("[" * 3000)
    markdown.parse("*a " * 2000)
    with pytest.raises(ValueError):
        archive.parse_xml("<a>" * 2000 + "</a>" * 2000)
    assert archive.parse_xml('<!DOCTYPE x [<!ENTITY a "b">]><x>&a;y&amp;</x>').text() == "y&"


def test_text_quirks():
    assert plain.parse_text("a\r\n\r\nb") == [("paragraph", [("text", "a\n\nb")])]
    assert B.trim_spans([("text", "  "), ("text", " a "), ("br",), ("text", " ")]) == [("text", "a")]
    assert T.py_percent_decode("a%20b+%zz%4") == "a b+%zz%4"
    assert T.py_resolve("OEBPS/", "../x/./y.html#f") == "x/y.html"
    assert sorted(["s10", "s2", "s1"], key=T.py_natural_key) == ["s1", "s2", "s10"]
    assert B.md(("list", False, [[], [("paragraph", [("text", "a")])]])) == "-\n- a\n"
    assert B.txt(("list", True, [[], [("paragraph", [("text", "a")])]])) == "2. a\n"


def test_numbers():
    assert [V.py_serial_date(s) for s in (45123, 59, 61, 0.5, 45123.75)] == ["2023-07-16", "1900-02-28", "1900-03-01", "12:00:00", "2023-07-16 18:00:00"]
    assert [V.py_number(v) for v in (4.0, 4.5, 1e20, -0.1, 1e-7)] == ["4", "4.5", "100000000000000000000", "-0.1", "0.0000001"]
    assert V.py_duration(1.5) == "36:00:00"
    assert V.py_pdf_date("D:20240131") == "2024-01-31" and V.py_pdf_date("2024") is None
    assert sheet._kind(0, "yyyy-mm-dd") == "date" and sheet._kind(0, '0.0 "day"') == "number" and sheet._kind(0, "[h]:mm") == "duration" and sheet._kind(14, None) == "date"


def test_page_ranges():
    assert formats.page_range("7") == (7, 7) and formats.page_range("3-") == (3, None) and formats.page_range(" 3-9 ") == (3, 9)
    for bad in ("", "0", "-3", "9-3", "a", "1-0"):
        with pytest.raises(ValueError):
            formats.page_range(bad)


def test_pdf_pages_and_columns():
    page = lambda word: [(12, 72, 700, word)]
    raw = pdf([page("one"), page("two"), page("three")])
    assert rendered(formats.extract("pdf", raw)[1]) == "one\n\n<!-- page 2 -->\n\ntwo\n\n<!-- page 3 -->\n\nthree\n"
    assert rendered(formats.extract("pdf", raw, (2, 3))[1]) == "two\n\n<!-- page 3 -->\n\nthree\n"
    rows = [(12, x, 700 - 14 * k, f"{side} column line {k} text") for side, x in (("left", 72), ("right", 330)) for k in range(4)]
    shown = rendered(formats.extract("pdf", pdf([rows]))[1])
    assert shown.index("left column line 3") < shown.index("right column line 0")
    assert formats.extract("pdf", pdf([page("no table")], table=False))[1] == [("paragraph", [("text", "no table")])]


def test_pdf_objects():
    lexer = P.Lexer(b"<< /A#20B [1 -2.5 (a\\(b\\051\\n) <414> 3 0 R true null] >>")
    assert lexer.value() == {"A B": [1, -2.5, b"a(b)\n", b"A@", P.Ref((3, 0)), True, None]}
    assert P._ascii85(b"87cURD]i,\"Ebo80~>") == b"Hello World!"
    assert P._run_length(b"\x02abc\xfed\x80") == b"abcddd"
    assert P._predicted(b"\x02\x01\x02\x02\x01\x01", {"Predictor": 12, "Columns": 2}) == b"\x01\x02\x02\x03"


def test_layout_helpers():
    assert pagelayout.upper_median([1, 2, 3, 4]) == 3
    assert pagelayout.body_size([("aa", 0, 0, 0, 10.0), ("bb", 0, 0, 0, 12.0)]) == 12.0
    assert pagelayout.column_bounds([(0, 10), (5, 20), (22, 30), (100, 120)], 5) == [(0, 30), (100, 120)]
    rows = [("infor-", 0, 100, 10, 10.0), ("mation goes on", 0, 100, 22, 10.0)]
    assert pagelayout.paragraphs(rows, 10.0) == [("paragraph", [("text", "information goes on")])]
    assert pagelayout.level(17, 10, 1, "x") == 1 and pagelayout.level(17, 10, 3, "x") is None


def test_pdf_streams_are_never_cut(monkeypatch):
    from docpipe.sources.formats import pdf as reader

    raw = pdf([[(12, 72, 700 - 14 * k, f"line {k} of the page") for k in range(40)]], compress=True)
    assert "line 39" in B.md(formats.extract("pdf", raw)[1][-1])
    monkeypatch.setattr(reader, "MAX_STREAM", 100)
    with pytest.raises(formats.Failure) as failed:
        formats.extract("pdf", raw)
    assert failed.value.reason == "parse_error" and "100 bytes" in failed.value.message


def test_pdf_tokens_with_and_without_escapes():
    data = b"12 -7 +3 .5 1234567890123456789012 /Name /A#20B /C#zz /(x) (a\\)b(c)) (plain) <41 42> true null % note\n q [1 0 R] << /K 2 0 R >> 5/N 6(s)7"
    lexer, found = P.Lexer(data), []
    while (v := lexer.value()) != P.END or not isinstance(v, P.Word):
        found.append(v)
    assert found == [12, -7, 3, 0.5, 1234567890123456789012, "Name", "A B", "C#zz", "", b"x", b"a)b(c)", b"plain", b"AB", True, None, b"q", [P.Ref((1, 0))], {"K": P.Ref((2, 0))}, 5, "N", 6, b"s", 7]
    assert [type(v) for v in found if isinstance(v, str)] == [P.Name] * 5 and type(found[15]) is P.Word


def test_pdf_upright_text_is_placed_as_any_other(monkeypatch):
    """Codes are measured once for each size and not once for each glyph."""
    from docpipe.plans import made

    orders = [{"key": k, "status": "F", "price": "10.50", "date": 9000 + k} for k in range(30)]
    raw, calls = made.make_pdf({"key": 1, "name": "Customer 1", "segment": "BUILDING", "balance": "5.25", "orders": orders}), []
    missing = P._Advances.__missing__
    monkeypatch.setattr(P._Advances, "__missing__", lambda self, code: calls.append(code) or missing(self, code))
    upright = [g for _, page in P.parse(raw)[1] for g in page]
    assert len(calls) < len(upright) / 10
    # A rise takes the general way; one of nothing at all changes no place.
    start = P._Painter.run
    monkeypatch.setattr(P._Painter, "run", lambda self, data, *rest: start(self, b"1e-300 Ts 5e-324 Ts 0.0000000000000000000000000000001 Ts " + data, *rest))
    general = [g for _, page in P.parse(raw)[1] for g in page]
    assert len(upright) == len(general) > 0
    for a, b in zip(upright, general):
        assert a[4] == b[4] and all(abs(x - y) < 1e-9 for x, y in zip(a[:4], b[:4]))


def test_page_regions_do_not_depend_on_the_order_of_glyphs():
    glyphs = [(x * 6.0 + side, 10.0 + 40 * k, 10.0, x * 6.0 + side + 5.5, chr(97 + x)) for k in range(9) for side in (0, 300) for x in range(20)]
    expected = pagelayout.page_blocks(glyphs)
    assert pagelayout.page_blocks(glyphs[::-1]) == expected and sum(len(b[1][0][1]) for b in expected) >= len(glyphs)


def test_archive_entries_without_zipfile(monkeypatch):
    """Plain entries are read in one go; what is wrong with an entry is still found."""
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", b"stored")
        z.writestr("b.txt", b"deflated " * 50, zipfile.ZIP_DEFLATED)
        z.writestr("c.txt", b"packed " * 50, zipfile.ZIP_BZIP2)
        z.writestr("é.txt", b"named", zipfile.ZIP_DEFLATED)
    raw, through = out.getvalue(), []
    read = zipfile.ZipFile.read
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda self, name: through.append(name) or read(self, name))
    found = archive.Archive(raw)
    assert [found.data(n) for n in ("a.txt", "b.txt", "c.txt", "é.txt", "none")] == [b"stored", b"deflated " * 50, b"packed " * 50, b"named", None]
    assert through == ["c.txt", "é.txt"]
    assert archive.Archive(raw.replace(b"stored", b"sTored")).data("a.txt") is None
    assert archive.Archive(b"before" + raw).data("b.txt") == b"deflated " * 50


def test_percent_decoding():
    from docpipe.functions.text import py_percent_decode

    assert py_percent_decode("a%20b+c%zz%4%C3%A9%+1%") == "a b+c%zz%4é\x01%" and py_percent_decode("é plain") == "é plain"


def test_made_archives_are_whole():
    import io
    import zipfile

    from docpipe.plans import made

    z = zipfile.ZipFile(io.BytesIO(made._zip({"a/é.xml": "<ä/>", "b.xml": ""}, "application/epub+zip")))
    assert z.testzip() is None and z.namelist()[0] == "mimetype" and z.read("mimetype") == b"application/epub+zip" and z.read("b.xml") == b""
