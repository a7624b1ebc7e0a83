"""Queries over files that are made of table rows: every customer and their orders become a file of
each format, in tasks; the files go through detection, extraction and rendering as a user's would,
and SQL says over the same rows what must come out.

Each maker takes a customer (key, name, segment, balance, orders) and returns bytes; orders are
(key, status, price, date as days since 1970), by key.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import chunk as C, extract as E, render
from .catalogue import query, table

Maker = Callable[[dict], bytes]


def _zip(parts: dict[str, str], mimetype: str | None = None) -> bytes:
    out, places = bytearray(), bytearray()
    stored = [("mimetype", mimetype.encode(), 0)] if mimetype else []
    entries = [*stored, *((name, body.encode(), 8) for name, body in parts.items())]
    for name, body, method in entries:
        packed, utf8, name = body, 0 if name.isascii() else 0x800, name.encode()
        if method:
            z = zlib.compressobj(6, zlib.DEFLATED, -15)
            packed = z.compress(body) + z.flush()
        # Version, flags, method, time and date (1980-01-01), checksum and sizes, as both headers have them.
        about = struct.pack("<HHHHHIIIHH", 20, utf8, method, 0, 33, zlib.crc32(body), len(packed), len(body), len(name), 0)
        places += b"PK\x01\x02\x14\x03" + about + struct.pack("<HHHII", 0, 0, 0, 0o600 << 16, len(out)) + name
        out += b"PK\x03\x04" + about + name + packed
    end = struct.pack("<HHHHIIH", 0, 0, len(entries), len(entries), len(places), len(out), 0)
    return bytes(out + places + b"PK\x05\x06" + end)


def make_docx(c: dict) -> bytes:
    run = lambda text, props="": f'<w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}<w:t xml:space="preserve">{text}</w:t></w:r>'
    para = lambda inner, props="": f'<w:p>{f"<w:pPr>{props}</w:pPr>" if props else ""}{inner}</w:p>'
    numbered = lambda text, level: para(run(text), f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{c["key"] + 1}"/></w:numPr>')
    cell = lambda text: f"<w:tc>{para(run(text))}</w:tc>"
    line = lambda *cells: f"<w:tr>{''.join(map(cell, cells))}</w:tr>"
    lists = "".join(numbered(f"Order {o['key']}", 0) + numbered(f"status {o['status']}", 1) for o in c["orders"])
    rows = "".join(line(o["key"], o["price"]) for o in c["orders"])
    body = (
        para(run(c["name"]), '<w:pStyle w:val="Heading2"/>')
        + para(run("Segment", "<w:b/>") + run(" is ") + run(c["segment"], "<w:i/>") + run(" ") + f'<w:hyperlink r:id="rId3">{run("profile")}</w:hyperlink>')
        + lists + f"<w:tbl>{line('order', 'price')}{rows}</w:tbl>"
        + para(f"<w:del><w:r><w:delText>struck</w:delText></w:r></w:del>{run('Balance')}<w:r><w:br/></w:r>{run(c['balance'])}")
    )
    numbering = (
        f'<w:numbering><w:abstractNum w:abstractNumId="{c["key"]}"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum>'
        f'<w:num w:numId="{c["key"] + 1}"><w:abstractNumId w:val="{c["key"]}"/></w:num></w:numbering>'
    )
    rels = f'<Relationships><Relationship Id="rId3" Target="https://example.org/before"/><Relationship Id="rId3" Target="https://example.org/c/{c["key"]}"/></Relationships>'
    core = f'<cp:coreProperties><dc:title>{c["name"]}</dc:title><dc:creator>{c["segment"]}</dc:creator><dc:language>en</dc:language></cp:coreProperties>'
    return _zip({
        "[Content_Types].xml": "<Types/>", "word/document.xml": f"<w:document><w:body>{body}</w:body></w:document>", "word/numbering.xml": numbering,
        "word/_rels/document.xml.rels": rels, "docProps/core.xml": core, "docProps/app.xml": f"<Properties><Pages>{len(c['orders'])}</Pages></Properties>",
    })


def make_pptx(c: dict) -> bytes:
    para = lambda text, level=0: f'<a:p><a:pPr lvl="{level}"/><a:r><a:t>{text}</a:t></a:r></a:p>'
    shape = lambda paras, kind="": f"<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody>{paras}</p:txBody></p:sp>"
    slides = [shape(para(c["segment"]) + para(f"balance {c['balance']}", 1) + para("orders")) + shape(para(c["name"]), '<p:ph type="title"/>')]
    for o in c["orders"]:
        slides.append(shape(para(f"status {o['status']}")) + (shape(para(f"Order {o['key']}"), '<p:ph type="ctrTitle"/>') if o["key"] % 2 else ""))
    # In the archive from last to first, under numbers that sort as numbers only.
    parts = {f"ppt/slides/slide{k + 1}.xml": f"<p:sld>{s}</p:sld>" for k, s in reversed(list(enumerate(slides)))}
    return _zip({"ppt/presentation.xml": "<p/>", **parts})


def make_xlsx(c: dict) -> bytes:
    words = ["order", "when", *sorted({o["status"] for o in c["orders"]})]
    shared = lambda at, text: f'<c r="{at}" t="s"><v>{words.index(text)}</v></c>'
    rows = [f'<row r="3">{shared("B3", "order")}<c r="C3" t="inlineStr"><is><t>price</t></is></c>{shared("D3", "when")}<c r="E3" t="str"><v>clock</v></c><c r="F3" t="str"><v>spent</v></c><c r="G3" t="str"><v>open</v></c><c r="H3" t="str"><v>status</v></c></row>']
    for k, o in enumerate(c["orders"]):
        r = k + 4
        rows.append(
            f'<row r="{r}"><c r="B{r}"><v>{o["key"]}</v></c><c r="C{r}"><v>{o["price"]}</v></c><c r="D{r}" s="1"><v>{o["date"] + 25569}</v></c><c r="E{r}" s="2"><v>{o["key"] % 1440 / 1440!r}</v></c>'
            f'<c r="F{r}" s="3"><v>{o["key"] % 5000 / 1440!r}</v></c><c r="G{r}" t="b"><v>{int(o["status"] == "O")}</v></c>{shared(f"H{r}", o["status"])}</row>'
        )
    styles = '<styleSheet><numFmts><numFmt numFmtId="180" formatCode="[h]:mm:ss"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="21"/><xf numFmtId="180"/></cellXfs></styleSheet>'
    return _zip({
        "xl/workbook.xml": '<workbook><sheets><sheet name="Orders" sheetId="1" r:id="rId9"/><sheet name="Blank" sheetId="2" r:id="rId8"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId8" Target="/xl/worksheets/sheet1.xml"/><Relationship Id="rId9" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst>" + "".join(f"<si><r><t>{w[:1]}</t></r><r><t>{w[1:]}</t></r></si>" for w in words) + "</sst>", "xl/styles.xml": styles,
        "xl/worksheets/sheet1.xml": "<worksheet><sheetData/></worksheet>", "xl/worksheets/sheet2.xml": f"<worksheet><sheetData>{''.join(rows)}</sheetData></worksheet>",
    })


def make_odt(c: dict) -> bytes:
    item = lambda o: f'<text:list-item><text:p>Order {o["key"]}</text:p><text:list><text:list-item><text:p>status {o["status"]}</text:p></text:list-item></text:list></text:list-item>'
    items = f'<text:list text:style-name="Counted">{"".join(map(item, c["orders"]))}</text:list>' if c["orders"] else ""
    content = (
        '<office:document-content><office:automatic-styles><style:style style:name="Strong"><style:text-properties fo:font-weight="bold"/></style:style>'
        '<text:list-style style:name="Counted"><text:list-level-style-number text:level="1"/><text:list-level-style-bullet text:level="2"/></text:list-style></office:automatic-styles>'
        f'<office:body><office:text><text:h text:outline-level="3">{c["name"]}</text:h><text:p>Segment<text:s text:c="2"/><text:span text:style-name="Strong">{c["segment"]}</text:span></text:p>{items}'
        f'<text:p>Balance<text:line-break/>{c["balance"]}</text:p></office:text></office:body></office:document-content>'
    )
    meta = f'<office:document-meta><office:meta><dc:title>{c["name"]}</dc:title><meta:initial-creator>{c["segment"]}</meta:initial-creator><meta:document-statistic meta:page-count="{len(c["orders"]) + 1}"/></office:meta></office:document-meta>'
    return _zip({"content.xml": content, "meta.xml": meta}, "application/vnd.oasis.opendocument.text")


def make_odp(c: dict) -> bytes:
    page = lambda name, *texts: f'<draw:page draw:name="{name}"><draw:frame><draw:text-box>{"".join(f"<text:p>{t}</text:p>" for t in texts)}</draw:text-box></draw:frame></draw:page>'
    pages = page("p0", c["name"], c["segment"]) + "".join(page(f"Order {o['key']}") if o["key"] % 2 else page(f"p{o['key']}", f"Order {o['key']}", f"status {o['status']}") for o in c["orders"])
    return _zip({"content.xml": f"<o><office:body><office:presentation>{pages}</office:presentation></office:body></o>"}, "application/vnd.oasis.opendocument.presentation")


def make_ods(c: dict) -> bytes:
    word = lambda text: f'<table:table-cell office:value-type="string"><text:p>{text}</text:p></table:table-cell>'
    number = lambda n: f'<table:table-cell office:value-type="float" office:value="{n}"/>'
    row = lambda cells: f'<table:table-row>{cells}<table:table-cell table:number-columns-repeated="900"/></table:table-row>'
    rows = row(word("order") + word("price") + word("status")) + "".join(row(number(o["key"]) + number(o["price"]) + word(o["status"])) for o in c["orders"])
    content = f'<o><office:body><office:spreadsheet><table:table table:name="{c["segment"]}">{rows}<table:table-row table:number-rows-repeated="100000"><table:table-cell/></table:table-row></table:table></office:spreadsheet></office:body></o>'
    return _zip({"content.xml": content}, "application/vnd.oasis.opendocument.spreadsheet")


def make_epub(c: dict) -> bytes:
    """Chapters by key in the spine, the other way round in the manifest, where each id comes twice."""
    chapter = lambda o: f'<html><head><title>Order {o["key"]}</title></head><body>{"<h3>Named " + str(o["key"]) + "</h3>" if o["key"] % 2 else ""}<p>status <b>{o["status"]}</b></p></body></html>'
    items = "".join(f'<item id="c{o["key"]}" href="text/order%20{o["key"]}.xhtml#top"/><item id="c{o["key"]}" href="text/other.xhtml"/>' for o in reversed(c["orders"]))
    spine = '<itemref idref="nav" linear="no"/>' + "".join(f'<itemref idref="c{o["key"]}"/>' for o in c["orders"]) + '<itemref idref="missing"/><itemref idref="end"/>'
    opf = (
        f'<package><metadata><dc:title>{c["name"]}</dc:title><dc:creator>{c["segment"]}</dc:creator><dc:language>en</dc:language><dc:publisher>Tables</dc:publisher></metadata>'
        f'<manifest>{items}<item id="nav" href="nav.xhtml"/><item id="end" href="../OPS/./text/end.xhtml"/></manifest><spine>{spine}</spine></package>'
    )
    chapters = {f"OPS/text/order {o['key']}.xhtml": chapter(o) for o in c["orders"]}
    return _zip({
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>', "OPS/book.opf": opf, **chapters,
        "OPS/text/other.xhtml": "<p>never</p>", "OPS/nav.xhtml": "<p>never</p>", "OPS/text/end.xhtml": f"<html><head><title>End</title></head><body><p>Balance {c['balance']}</p></body></html>",
    }, "application/epub+zip")


def _pdf(pages: list[list[tuple[float, float, float, str]]], info: str) -> bytes:
    """Pages of (size, x, y, text) in Helvetica."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", 4: f"<< {info} >>".encode()}
    kids = " ".join(f"{10 + 2 * k} 0 R" for k in range(len(pages)))
    objects[2] = f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> >>".encode()
    for k, rows in enumerate(pages):
        packed = zlib.compress("".join(f"BT /F1 {size} Tf {x} {y} Td ({text}) Tj ET\n" for size, x, y, text in rows).encode())
        objects[10 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * k)
        objects[11 + 2 * k] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream"
    out, places = bytearray(b"%PDF-1.5\n"), {}
    for n in sorted(objects):
        places[n] = len(out)
        out += b"%d 0 obj\n" % n + objects[n] + b"\nendobj\n"
    at = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, places[n]) for n in sorted(places))
    return bytes(out + b"trailer << /Root 1 0 R /Info 4 0 R /Size %d >>\nstartxref\n%d\n%%%%EOF" % (max(objects) + 1, at))


def make_pdf(c: dict) -> bytes:
    """A title, then a paragraph of two lines for each order, twelve to a page."""
    pages = []
    for first in range(0, max(1, len(c["orders"])), 12):
        rows, y = [], 740
        if first == 0:
            rows += [(24, 72, y, c["name"]), (12, 72, y - 40, f"This customer buys for {c['segment']} and has a balance of {c['balance']}.")]
            y -= 90
        for o in c["orders"][first : first + 12]:
            rows += [(12, 72, y, f"Order {o['key']:09d} came in on day {o['date']:05d} and was worth {float(o['price']):012.2f} in"), (12, 72, y - 14, f"all; its status is {o['status']}.")]
            y -= 50
        pages.append(rows)
    return _pdf(pages, f"/Title ({c['name']}) /Author ({c['segment']}) /CreationDate (D:20230501100000Z)")


def make_columns(c: dict) -> bytes:
    """A page of two columns, written line by line across both."""
    rows = []
    for k in range(8):
        rows += [(10, 330, 700 - 14 * k, f"Right {k} of customer {c['key']:09d} here"), (10, 72, 700 - 14 * k, f"Left {k} of customer {c['key']:09d} here")]
    return _pdf([rows], "")


def make_rtf(c: dict) -> bytes:
    orders = "".join(rf"Order {o['key']}\line status {{\b {o['status']}}} \emdash  {o['price']}\par " for o in c["orders"])
    return (rf"{{\rtf1\ansi\uc1{{\fonttbl{{\f0 Times;}}}}{{\info{{\title {c['name']}}}{{\author {c['segment']}}}{{\creatim\yr2023\mo5\dy1}}}}{{\*\generator none}}Caf\u233?\'e9 {{\i {c['segment']}}}\par {orders}}}").encode()


def make_markdown(c: dict) -> bytes:
    rows = "".join(f"| {o['key']} | *{o['status']}* |\n" for o in c["orders"])
    items = "".join(f"* Order {o['key']}\n  1) status {o['status']}\n" for o in c["orders"])
    code = "".join(f"pay({o['key']}, {o['price']});\n" for o in c["orders"])
    return f"{c['name']}\n===\n\n> __Segment__ [{c['segment']}][s]\n> goes on\n\n{items}\n| order | status |\n|:--|--:|\n{rows}\n```js run\n{code}```\n\n[s]: https://example.org/{c['key']} 'x'\n".encode()


def make_csv(c: dict) -> bytes:
    rows = "".join(f'{o["key"]},"{o["status"]}, ""{o["price"]}""",a|b\r\n' for o in c["orders"])
    return ("order,note,more,\r\n" + rows + f"{c['key']},{c['name']}\r\n").encode()


def make_html(c: dict) -> bytes:
    items = "".join(f"<li>Order {o['key']}<ol><li>status <em>{o['status']}</em></ol>" for o in c["orders"])
    rows = "".join(f"<tr><td>{o['key']}<td>{o['price']}|" for o in c["orders"])
    return (
        f"<!DOCTYPE html><html lang=en><head><title>{c['name']} &amp; co</title><meta name=author content='{c['segment']}'><style>p {{}}</style></head><body><nav>skip</nav><h4>{c['name']}</h4><p>Segment\n <strong>{c['segment']}</strong><br>see <a href='/c/{c['key']}'>page</a>"
        f"<ul>{items}</ul><table><thead><tr><th>order<th>price</thead>{rows}</table><pre><code class='language-sql'>select {c['balance']}\n</code></pre><img src=x alt='picture of {c['key']}'><script>no()</script><footer>skip</footer></body></html>"
    ).encode()


MAKERS: dict[str, Maker] = {"docx": make_docx, "pptx": make_pptx, "xlsx": make_xlsx, "odt": make_odt, "odp": make_odp, "ods": make_ods, "epub": make_epub, "pdf": make_pdf, "columns": make_columns, "rtf": make_rtf, "markdown": make_markdown, "csv": make_csv, "html": make_html}


#: Rows of customers and orders for a task at most, on average; files made between two batches.
TASK_ROWS, MADE_ROWS, MADE_BYTES = 25_000, 64, 4 << 20


def files(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(doc_id, content, format), a file for each customer; formats with a signature are detected
    from the bytes, whatever the extension says, the rest by it.

    Rows are few bytes and files are much work, so partitions are by number of rows: adaptive
    execution would merge them by their bytes into a few tasks of many files each."""
    from ..sources.detect import detect

    order = F.struct(
        F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.format_string("%.2f", "o_totalprice").alias("price"), F.unix_date(F.to_date("o_orderdate")).alias("date"),
    )
    customer, orders = table(spark, folder, "customer"), table(spark, folder, "orders")
    n = max(spark.sparkContext.defaultParallelism, -(-(customer.count() + orders.count()) // TASK_ROWS))
    orders = orders.repartition(n, "o_custkey").groupBy("o_custkey").agg(F.array_sort(F.collect_list(order)).alias("orders"))
    rows = customer.repartition(n, "c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.format_string("%.2f", "c_acctbal").alias("balance"), F.coalesce("orders", F.array()).alias("orders"),
    )
    make = MAKERS[kind]

    def packed(keys: list[int], found: list[bytes]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(keys, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found, size = [], [], 0
        for batch in batches:
            for c in (c for k in range(0, batch.num_rows, MADE_ROWS) for c in batch.slice(k, MADE_ROWS).to_pylist()):
                keys.append(c["key"])
                found.append(make(c))
                size += len(found[-1])
                if size > MADE_BYTES or len(found) >= MADE_ROWS:
                    yield packed(keys, found)
                    keys, found, size = [], [], 0
        if found:
            yield packed(keys, found)

    name = {"rtf": None, "markdown": "Md", "csv": "CSV"}.get(kind, "bin")
    return rows.mapInArrow(run, "doc_id long, content binary").select("doc_id", "content", detect(F.col("content"), F.lit(name).cast("string")).alias("format"))


def documents(spark: SparkSession, folder: str, kind: str, *fields: str) -> DataFrame:
    """Of the blocks, the fields alone that are rendered."""
    return E.extract(files(spark, folder, kind), fields=fields)


def shown(spark: SparkSession, folder: str, kind: str, *meta: str) -> DataFrame:
    """(doc_id, format, output, chosen metadata) of the files. A file that says 0 pages has no page
    count to its parser; here, as in SQL, the count is 0."""
    docs = documents(spark, folder, kind, "md")
    output = render.markdown(F.col("blocks")).alias("output")
    about = {m: F.col(f"meta.{m}") for m in meta}
    if "page_count" in about:
        about["page_count"] = F.when(F.col("reason").isNull(), F.coalesce(about["page_count"], F.lit(0)))
    return docs.select("doc_id", "format", "reason", output, *(v.alias(m) for m, v in about.items()))


# -------------------------------------------------------- what must come out --

_ROWS = """o as (select c_custkey as k, c_name as name, c_mktsegment as seg, printf('%.2f', c_acctbal) as bal, o_orderkey as ok, o_orderstatus as st, printf('%.2f', o_totalprice) as price, o_totalprice as cost, o_orderdate::date as d,
  row_number() over (partition by c_custkey order by o_orderkey) as n, count(o_orderkey) over (partition by c_custkey) as m from customer left join orders on o_custkey = c_custkey)"""
_NL, _GAP = "chr(10)", "chr(10) || chr(10)"
_NUMBER = "case when cost = floor(cost) then cost::bigint::varchar else cost::varchar end"
_COUNTED = "string_agg(n || '. Order ' || ok || chr(10) || repeat(' ', length(n || '. ')) || '- status ' || st, chr(10) order by n)"
_BULLETS = "string_agg('- Order ' || ok || chr(10) || '  1. status ' || st, chr(10) order by n)"


def _table(*columns: tuple[str, str]) -> tuple[str, str, str]:
    """Widths by k, the columns they add, and the Markdown of a table of (title, cell)."""
    widths = ", ".join(f"greatest(3, {len(h)}, max(length({x})))::int as w{i}" for i, (h, x) in enumerate(columns))
    line = lambda cells: "'| ' || " + " || ' | ' || ".join(cells) + " || ' |'"
    head = line([f"rpad('{h}', w{i}, ' ')" for i, (h, _) in enumerate(columns)])
    rule = line([f"repeat('-', w{i})" for i in range(len(columns))])
    rows = line([f"rpad({x}, w{i}, ' ')" for i, (_, x) in enumerate(columns)])
    markdown = f"{head} || chr(10) || {rule} || coalesce(chr(10) || string_agg({rows}, chr(10) order by n), '')"
    return widths, "".join(f", w{i}" for i in range(len(columns))), markdown


def _sql(kind: str, blocks: list[str], table: tuple[str, str, str] | None = None, rows: str = _ROWS, **meta: str) -> str:
    widths, names, _ = table or ("1 as w0", ", w0", "")
    about = "".join(f", {v} as {k}" for k, v in meta.items())
    return f"""with {rows}, w as (select k, {widths} from o group by k)
select k as doc_id, '{kind}' as format, null::varchar as reason, array_to_string(list_filter([{', '.join(blocks)}], lambda x: x is not null), {_GAP}) || chr(10) as output{about}
from o join w using (k) group by k, name, seg, bal, m{names}"""


def _made(kind: str, sql: str, *meta: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return shown(spark, folder, kind, *meta)

    run.__name__ = f"{kind}_files"
    query(sql)(run)


_BY_PRICE = _table(("order", "ok::varchar"), ("price", "price"))
_made("docx", _sql("docx", [
    "'## ' || name", "'**Segment** is *' || seg || '* [profile](https://example.org/c/' || k || ')'", _COUNTED, _BY_PRICE[2], "'Balance  ' || chr(10) || bal",
], _BY_PRICE, title="name", author="seg", language="'en'", page_count="m::int"), "title", "author", "language", "page_count")

_made("pptx", _sql("pptx", [
    "'## ' || name", "'- ' || seg || chr(10) || '  - balance ' || bal || chr(10) || '- orders'",
    f"string_agg('<!-- page ' || (n + 1) || ' -->' || {_GAP} || '## ' || case when ok % 2 = 1 then 'Order ' || ok else 'Slide ' || (n + 1) end || {_GAP} || 'status ' || st, {_GAP} order by n)",
], page_count="(m + 1)::int"), "page_count")

_SHEET = _table(
    ("order", "ok::varchar"), ("price", _NUMBER), ("when", "strftime(d, '%Y-%m-%d')"), ("clock", "printf('%02d:%02d:00', (ok % 1440 // 60)::int, (ok % 60)::int)"),
    ("spent", "printf('%d:%02d:00', (ok % 5000 // 60)::int, (ok % 5000 % 60)::int)"), ("open", "case when st = 'O' then 'TRUE' when st is not null then 'FALSE' end"), ("status", "st"),
)
_made("xlsx", _sql("xlsx", ["'## Orders'", _SHEET[2]], _SHEET))

_made("odt", _sql("odt", ["'### ' || name", "'Segment  **' || seg || '**'", _COUNTED, "'Balance  ' || chr(10) || bal"], title="name", author="seg", page_count="(m + 1)::int"), "title", "author", "page_count")

_made("odp", _sql("odp", [
    "'## ' || name", "seg",
    f"string_agg('<!-- page ' || (n + 1) || ' -->' || {_GAP} || '## Order ' || ok || case when ok % 2 = 0 then {_GAP} || 'status ' || st else '' end, {_GAP} order by n)",
]))

_ODS = _table(("order", "ok::varchar"), ("price", _NUMBER), ("status", "st"))
_made("ods", _sql("ods", ["'## ' || seg", _ODS[2]], _ODS))

_made("epub", _sql("epub", [
    f"string_agg(case when ok % 2 = 1 then '### Named ' else '# Order ' end || ok || {_GAP} || 'status **' || st || '**', {_GAP} order by n)", "'# End'", "'Balance ' || bal",
], title="name", author="seg", language="'en'", publisher="'Tables'"), "title", "author", "language", "publisher")

_made("pdf", _sql("pdf", [
    "'# ' || name", "'This customer buys for ' || seg || ' and has a balance of ' || bal || '.'",
    f"string_agg(case when n > 1 and n % 12 = 1 then '<!-- page ' || (n // 12 + 1) || ' -->' || {_GAP} else '' end || 'Order ' || printf('%09d', ok) || ' came in on day ' || printf('%05d', date_diff('day', date '1970-01-01', d)) || ' and was worth ' || printf('%012.2f', cost) || ' in all; its status is ' || st || '.', {_GAP} order by n)",
], title="name", author="seg", created="'2023-05-01'", page_count="greatest(1, (m + 11) // 12)::int"), "title", "author", "created", "page_count")

_made("columns", _sql("pdf", [" || ' ' || ".join(f"'{side} {i} of customer ' || printf('%09d', k) || ' here'" for i in range(8)) for side in ("Left", "Right")]))

_made("rtf", _sql("rtf", [
    "'Caféé *' || seg || '*'", f"string_agg('Order ' || ok || '  ' || chr(10) || 'status **' || st || '** — ' || price, {_GAP} order by n)",
], title="name", author="seg", created="'2023-05-01'"), "title", "author", "created")

_MARKS = _table(("order", "ok::varchar"), ("status", "'*' || st || '*'"))
_made("markdown", _sql("markdown", [
    "'# ' || name", "'**Segment** [' || seg || '](https://example.org/' || k || ') goes on'", _BULLETS, _MARKS[2],
    "'```js' || chr(10) || coalesce(string_agg('pay(' || ok || ', ' || price || ');', chr(10) order by n), '') || chr(10) || '```'",
], _MARKS, title="name"), "title")

_LINES = _table(("order", "one"), ("note", "two"), ("more", "three"), ("", "''"))
_made("csv", _sql("csv", [_LINES[2]], _LINES, _ROWS.replace("o as", "r as") + """, o as (
  select k, name, seg, bal, m, n, ok::varchar as one, st || ', "' || price || '"' as two, 'a\\|b' as three from r where ok is not null
  union all select distinct k, name, seg, bal, m, m + 1, k::varchar, name, '' from r)"""))

_PAGE = _table(("order", "ok::varchar"), ("price", "price || '\\|'"))
_made("html", _sql("html", [
    "'#### ' || name", "'Segment **' || seg || '**  ' || chr(10) || 'see [page](/c/' || k || ')'", _BULLETS, _PAGE[2],
    "'```sql' || chr(10) || 'select ' || bal || chr(10) || '```'", "'![picture of ' || k || ']()'",
], _PAGE, title="name || ' & co'", author="seg", language="'en'"), "title", "author", "language")


@query(f"""with {_ROWS} select k as doc_id, name || {_GAP} || 'Segment is ' || seg || ' profile' || {_GAP}
  || coalesce(string_agg(n || '. Order ' || ok || {_GAP} || repeat(' ', length(n || '. ')) || '- status ' || st, chr(10) order by n) || {_GAP}, '')
  || 'order' || chr(9) || 'price' || coalesce(chr(10) || string_agg(ok || chr(9) || price, chr(10) order by n), '') || {_GAP} || 'Balance' || chr(10) || bal || chr(10) as output
from o group by k, name, seg, bal""")
def docx_text(spark: SparkSession, folder: str) -> DataFrame:
    return render.rendered(documents(spark, folder, "docx", "txt"), "text")


@query(f"""with {_ROWS} select k as doc_id, '{{"blocks":[{{"text":[{{"type":"text","value":"Caféé "}},{{"type":"italic","value":[{{"type":"text","value":"' || seg || '"}}]}}],"type":"paragraph"}}'
  || coalesce(string_agg(',{{"text":[{{"type":"text","value":"Order ' || ok || '"}},{{"type":"line_break"}},{{"type":"text","value":"status "}},{{"type":"bold","value":[{{"type":"text","value":"' || st || '"}}]}},{{"type":"text","value":" — ' || price || '"}}],"type":"paragraph"}}', '' order by n), '')
  || '],"meta":{{"title":"' || name || '","author":"' || seg || '","created":"2023-05-01","source_format":"rtf","source_path":"' || k || '"}}}}' || chr(10) as output
from o group by k, name, seg""")
def rtf_json(spark: SparkSession, folder: str) -> DataFrame:
    return render.rendered(documents(spark, folder, "rtf", "json"), "json")


@query(f"""with {_ROWS}, b as (
  select distinct k, 0 as i, -1 as p, 0 as item, 0 as depth, 'heading' as type, name as plain, 2 as level from o
  union all select distinct k, 1, -1, 0, 0, 'paragraph', 'Segment is ' || seg || ' profile', null from o
  union all select k, 2, -1, 0, 0, 'list', string_agg('Order ' || ok || chr(10) || 'status ' || st, chr(10) order by n), null from o where ok is not null group by k
  union all select k, 3 * n, 2, n - 1, 1, 'paragraph', 'Order ' || ok, null from o where ok is not null
  union all select k, 3 * n + 1, 2, n - 1, 1, 'list', 'status ' || st, null from o where ok is not null
  union all select k, 3 * n + 2, 3 * n + 1, 0, 2, 'paragraph', 'status ' || st, null from o where ok is not null
  union all select k, 2 + case when m > 0 then 3 * m + 1 else 0 end, -1, 0, 0, 'table', 'order' || chr(9) || 'price' || coalesce(chr(10) || string_agg(ok || chr(9) || price, chr(10) order by n), ''), null from o group by k, m
  union all select distinct k, 3 + case when m > 0 then 3 * m + 1 else 0 end, -1, 0, 0, 'paragraph', 'Balance' || chr(10) || bal, null from o)
select k as doc_id, i::int as block_idx, p::int as parent_idx, item::int as item_no, depth::int as depth, type, plain, coalesce(level, 0)::int as level from b""")
def docx_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks as rows in pre-order, with their parents."""
    fields = ("block_idx", "parent_idx", "item_no", "depth", "type", "plain", "level")
    found = E.extract(files(spark, folder, "docx"), full=True, fields=fields).select("doc_id", F.explode("blocks").alias("b"))
    return found.select("doc_id", "b.block_idx", F.coalesce("b.parent_idx", F.lit(-1)).alias("parent_idx"), F.coalesce("b.item_no", F.lit(0)).alias("item_no"), "b.depth", "b.type", "b.plain", F.coalesce("b.level", F.lit(0)).alias("level"))


# ----------------------------------------------------------------- chunks --

_SECTIONS = """
with recursive c as (select c_custkey // 50 as doc, c_custkey as k, row_number() over (partition by c_custkey // 50 order by c_custkey) as p, c_name, c_mktsegment, printf('%.2f', c_acctbal) as bal from customer),
b as materialized (select doc, 0 as i, 1 as level, 'Book ' || doc as h, '# Book ' || doc as md from c where p = 1
      union all select doc, 2 * p - 1, 2 + k % 3, 'Customer ' || k, repeat('#', (2 + k % 3)::int) || ' Customer ' || k from c
      union all select doc, 2 * p, null, null, c_name || ' of ' || c_mktsegment || ' has ' || bal || ' to spend.' from c),
f as materialized (select b.doc, b.i, list(a.h order by a.i) as path from b join b a on a.doc = b.doc and a.i <= b.i and a.level is not null
        and not exists (select 1 from b x where x.doc = a.doc and x.i > a.i and x.i <= b.i and x.level <= a.level) group by b.doc, b.i),
s as materialized (select b.doc, b.i, b.level is not null as heading, length(b.md) as n, f.path, coalesce(sum(length(b.md) + 2) over (partition by b.doc order by b.i rows between unbounded preceding and 1 preceding), 0) as low from b join f using (doc, i)),
p as (select doc, i, n as chars, i as start, len(path) as depth from s where i = 0
      union all select doc, i, case when breaks then n else chars + 2 + n end, case when breaks then i else start end, len(path)
      from (select s.*, p.chars, p.start, p.chars + 2 + s.n > 200 or s.heading and (2 * p.chars >= 200 or len(s.path) < p.depth) as breaks from p join s on s.doc = p.doc and s.i = p.i + 1)),
g as (select doc, start, max(i) as last, row_number() over (partition by doc order by start) - 1 as chunk_idx, lag(start) over (partition by doc order by start) as before from p group by doc, start),
w as materialized (select doc, string_agg(md, chr(10) || chr(10) order by i) as whole from b group by doc),
l as materialized (select doc, list(low order by i) as low, list(low + n order by i) as high, list(path order by i) as path from s group by doc),
r as (select g.*, coalesce(list_min(list_filter(range(before + 1, start), lambda i: l.low[start + 1] - l.low[i + 1] <= 80)), start) as first, l.low as lows, l.high[last + 1] as high, l.path[start + 1] as path from g join l using (doc)),
t as (select doc, chunk_idx, substr(whole, (lows[first + 1] + 1)::int, (high - lows[first + 1])::int) as text, path, lows[first + 1] as low, high from r join w using (doc))
"""


@query(_SECTIONS + """select doc as doc_id, chunk_idx::int as chunk_idx, text, array_to_string(path, ' > ') as path, doc::varchar as source, low::bigint as low, high::bigint as high,
  'sha256:' || sha256(array_to_string(path, chr(31)) || chr(30) || text) as hash from t""")
def chunk_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Heading paths, packing, overlaps, byte ranges and hashes."""
    return _flat(_sections(spark, folder))


def _sections(spark: SparkSession, folder: str) -> DataFrame:
    """Customers, fifty to a page with a heading for each, to chunks of 200 characters with an overlap
    of 80."""
    key = F.col("c_custkey")
    level = (key % 3 + 2).cast("string")
    line = F.format_string("<h%s>Customer %d</h%s><p>%s of %s has %.2f to spend.</p>", level, key, level, "c_name", "c_mktsegment", "c_acctbal")
    book = table(spark, folder, "customer").groupBy(F.floor(key / 50).alias("book")).agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), line.alias("line")))).alias("l"))
    page = F.concat(F.format_string("<html><body><h1>Book %d</h1>", "book"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("</body></html>"))
    return C.chunks(E.html_documents(book.select("book", page.alias("page")), "book", "page"), 200, 80)


@query(_SECTIONS + """select doc as doc_id, string_agg('<!-- chunk ' || (chunk_idx + 1) || '/' || n || ' | ' || array_to_string(path, ' > ') || ' | bytes ' || low || '-' || high || ' | sha256:'
  || left(sha256(array_to_string(path, chr(31)) || chr(30) || text), 12) || '… -->' || chr(10) || chr(10) || text || chr(10) || chr(10), '' order by chunk_idx) as output
from (select *, count(*) over (partition by doc) as n from t) group by doc""")
def chunk_files(spark: SparkSession, folder: str) -> DataFrame:
    """A Markdown file of chunks for each page, a header line before each chunk."""
    return C.rendered(_sections(spark, folder), "md")


def _flat(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "chunk_idx", "text", F.array_join("heading_path", " > ").alias("path"), "source", F.col("byte_range")[0].alias("low"), F.col("byte_range")[1].alias("high"), "hash")


_KEPT = r"regexp_replace({x}, '([\p{L}\p{N}])_([\p{L}\p{N}])', '\1' || chr(57344) || '\2', 'g')"
_PIECES = r"""
with recursive raw as (select doc_id, regexp_replace(regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g'), '([\\`*\[\]<])', '\\\1', 'g') as t from documents),
m as materialized (select doc_id, regexp_replace(replace(replace(KEPT, '_', chr(92) || '_'), chr(57344), '_'), '^([{WS}]*)([#>|]|[-+] |[0-9]+[.)] )', '\1' || chr(92) || chr(92) || '\2') as md from raw where t <> ''),
c as (select doc_id, 0 as k, 0 as low, 0 as high, 0 as pos, md as rest from m
      union all
      select doc_id, k + 1, pos, pos + case when length(rest) <= 800 then length(rest) else length(regexp_replace(left(rest, cut::int), '[{WS}]+$', '')) end,
        case when length(rest) <= 800 then pos + length(rest) else pos + cut + length(regexp_extract(substr(rest, (cut + 1)::int), '^[{WS}]*')) end,
        case when length(rest) <= 800 then '' else regexp_replace(substr(rest, (cut + 1)::int), '^[{WS}]+', '') end
      from (select *, case when length(regexp_extract(left(rest, 800), '(?s)^(.+\n)', 1)) > 1 then length(regexp_extract(left(rest, 800), '(?s)^(.+\n)', 1))
                           when regexp_matches(left(rest, 800), '(?s)^.+[.!?…]([{WS}]|$)') then length(regexp_extract(left(rest, 800), '(?s)^(.+[.!?…])([{WS}]|$)', 1))
                           when regexp_matches(left(rest, 800), '(?s)^.+[{WS}]') then length(regexp_extract(left(rest, 800), '(?s)^(.+)[{WS}]', 1)) else 800 end as cut
            from c where rest <> '')),
s as materialized (select doc_id, row_number() over (partition by doc_id order by k) - 1 as i, low, high from c where k > 0 and high > low),
p as (select doc_id, i, high - low as chars, i as start, high from s where i = 0
      union all select doc_id, i, case when breaks then n else chars + gap + n end, case when breaks then i else start end, own
      from (select s.doc_id, s.i, p.chars, p.start, s.high as own, s.high - s.low as n, s.low - p.high as gap, p.chars + s.high - p.high > 800 as breaks from p join s on s.doc_id = p.doc_id and s.i = p.i + 1)),
g as (select doc_id, start, max(i) as last, row_number() over (partition by doc_id order by start) - 1 as chunk_idx, lag(start) over (partition by doc_id order by start) as before from p group by doc_id, start),
l as materialized (select doc_id, list(low order by i) as low, list(high order by i) as high from s group by doc_id),
r as (select g.*, coalesce(list_min(list_filter(range(before + 1, start), lambda i: l.low[start + 1] - l.low[i + 1] <= 80)), start) as first, l.low as lows, l.high[last + 1] as stop from g join l using (doc_id)),
t as (select doc_id, chunk_idx, substr(md, (lows[first + 1] + 1)::int, (stop - lows[first + 1])::int) as text, strlen(left(md, lows[first + 1]::int)) as low from r join m using (doc_id))
"""


@query(_PIECES.replace("KEPT", _KEPT.replace("{x}", _KEPT.replace("{x}", "t"))) + """select doc_id, chunk_idx::int as chunk_idx, text, '' as path, doc_id::varchar as source, low::bigint as low, (low + strlen(text))::bigint as high, 'sha256:' || sha256(chr(30) || text) as hash from t""")
def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All documents to chunks of 800 characters with an overlap of 80, and their hashes."""
    return _flat(C.chunks(E.text_documents(table(spark, folder, "documents"), "doc_id", "text"), 800, 80))
