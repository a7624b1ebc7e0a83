"""DataFrame operators: parity with the parsers' Python, chunk invariants, batches, streams, SQL."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F
from samples import ALL, pdf

from docpipe.functions import text as T, values as V
from docpipe.operators import chunk as C, extract as E, layout as L, render, status
from docpipe.plans import api, catalogue, made  # noqa: F401  made adds its queries
from docpipe.sources import detect as D, formats, listing
from docpipe.sources.formats import pagelayout
from docpipe.streaming import ingest

TEXTS = ["", " ", "a_b _c_ `d` *e* [f] <g> \\", "# h", "  - x", "+ y", "12) z", "1.z", "é_ü", "  x y　", "#", "|t", ">q", "``` `` `", "日本語\t\n 😀", "a\u001cb"]


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["o"] for r in rows.select("k", f(F.col("v")).alias("o")).orderBy("k").collect()]


def test_columns_equal_python(spark):
    for expr, twin in ((T.escape_markdown, T.py_escape_markdown), (T.escape_leading, T.py_escape_leading), (T.one_line, T.py_one_line), (T.squeeze, T.py_squeeze), (T.trimu, lambda s: s.strip(T.WS)), (T.longest_backticks, T.py_longest_backticks), (T.escape_href, T.py_escape_href)):
        assert column(spark, TEXTS, expr) == list(map(twin, TEXTS))
    serials = [0.0, 0.5, 0.999999, 1.0, 59.0, 60.0, 61.0, 45123.0, 45123.75]
    assert column(spark, serials, V.serial_date, "double") == list(map(V.py_serial_date, serials))
    assert column(spark, serials, V.duration, "double") == list(map(V.py_duration, serials))
    dates = ["D:20240131", "D:D:20240131120000Z", "2024", "20240131", "x"]
    assert column(spark, dates, V.pdf_date) == list(map(V.py_pdf_date, dates))
    paths = ["../a/./b#c", "x?y", "../../../z", ""]
    assert column(spark, paths, lambda p: T.resolve_path(F.lit("in/dir/"), p)) == [T.py_resolve("in/dir/", p) for p in paths]


def test_hash_golden(spark):
    import hashlib

    want = "sha256:" + hashlib.sha256("Introduction\x1fPart\x1eBody.".encode()).hexdigest()
    one = spark.range(1).select(T.content_hash(F.array(F.lit("Introduction"), F.lit("Part")), F.lit("Body.")).alias("h"))
    assert one.first()["h"] == want


@pytest.fixture(scope="module")
def inbox(tmp_path_factory):
    root = tmp_path_factory.mktemp("inbox")
    for k, (name, (raw, _, _)) in enumerate(ALL.items()):
        folder = root / f"d{k % 3}"
        folder.mkdir(exist_ok=True)
        (folder / name).write_bytes(raw)
    (root / "report.txt").write_text("same stem")
    (root / "report.csv").write_text("a,b\n")
    (root / ".hidden.txt").write_text("hidden")
    (root / "unknown.bin").write_bytes(b"\x00\x01")
    (root / "blank.txt").write_text("\n")
    (root / "scan.pdf").write_bytes(pdf([[]]))
    (root / "broken.docx").write_bytes(b"PK\x03\x04")
    (root / "misnamed.dat").write_bytes(ALL["b.docx"][0])
    return root


def test_detection_of_all_formats(spark, inbox):
    jobs, problems = listing.list_inputs(spark, [str(inbox), str(inbox / "none")], recursive=True)
    found = {os.path.basename(r["doc_id"]): r["format"] for r in listing.read_jobs(jobs).select("doc_id", "format").collect()}
    assert {n: found[n] for n in ALL} == {n: kind for n, (_, _, kind) in ALL.items()}
    assert found["misnamed.dat"] == "docx" and found["unknown.bin"] is None and found[".hidden.txt"] == "txt"
    assert problems.count() == 1
    tree = listing.read_tree(spark, str(inbox)).select("doc_id", "relative", "format").collect()
    assert {os.path.basename(r["doc_id"]) for r in tree} == set(found) - {".hidden.txt"}
    assert all(r["doc_id"] == str(inbox / r["relative"]) for r in tree)


def test_batch(spark, inbox, tmp_path):
    out = tmp_path / "out"
    done = api.run_batch(spark, [str(inbox)], output=str(out), recursive=True, manifest=str(tmp_path / "m" / "manifest.json"))
    assert (done.extracted, done.skipped, done.failed, done.exit_code) == (len(ALL) + 4, 3, 1, 1)
    assert done.summary == f"{len(ALL) + 4} extracted, 3 skipped, 1 failed"
    for k, (name, (_, shown, _)) in enumerate(ALL.items()):
        stem = name.rpartition(".")[0]
        place = out / f"d{k % 3}"
        at = place / f"{stem}.md" if (place / f"{stem}.md").exists() else place / f"{name}.md"
        assert at.read_text() == shown
    assert (out / "report.txt.md").exists() and (out / "report.csv.md").exists() and (out / "misnamed.md").exists() and (out / ".hidden.md").exists()
    rows = {os.path.basename(r["source"]): r for r in json.loads((tmp_path / "m" / "manifest.json").read_text())}
    assert rows["scan.pdf"] == {"source": str(inbox / "scan.pdf"), "output": None, "status": "skipped", "reason": "no_text_layer", "format": "pdf"}
    assert rows["broken.docx"]["status"] == "error" and rows["broken.docx"]["reason"] == "parse_error"
    assert rows["unknown.bin"]["reason"] == "unsupported_format" and rows["unknown.bin"]["format"] is None


@pytest.mark.parametrize(("names", "code"), [(["report.txt"], 0), (["unknown.bin"], 5), (["scan.pdf"], 4), (["broken.docx"], 1), (["lost"], 1), (["d0"], 1), (["report.txt", "scan.pdf"], 4)])
def test_exit_codes(spark, inbox, names, code):
    assert api.run_batch(spark, [str(inbox / n) for n in names]).exit_code == code


def test_pages_and_metadata(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(pdf([[(12, 72, 700, word)] for word in ("one", "two", "three")]))
    said = lambda **more: api.convert(spark, [str(tmp_path / "x.pdf")], **more).first()["output"]
    assert said(pages="2-") == "two\n\n<!-- page 3 -->\n\nthree\n"
    assert said(pages="1", metadata=True) == '---\ntitle: "Report"\nauthor: "A. B."\ncreated: "2024-01-31"\npages: 3\nformat: "pdf"\n---\n\none\n'
    assert said(format="text", pages="3") == "three\n"
    whole = json.loads(said(format="json"))
    assert whole["meta"]["page_count"] == 3 and [b["type"] for b in whole["blocks"]] == ["paragraph", "page_break", "paragraph", "page_break", "paragraph"]
    with pytest.raises(ValueError):
        api.convert(spark, ["x"], pages="0")


def test_ocr_adds_and_never_fails(spark, inbox):
    jobs, _ = listing.list_inputs(spark, [str(inbox / "scan.pdf"), str(inbox / "unknown.bin"), str(inbox / "report.txt")])
    searchable = pdf([[(12, 72, 700, "read")]])

    def reader(raw):
        if raw.startswith(b"%PDF"):
            return searchable
        raise OSError("no")

    found = {os.path.basename(r["doc_id"]): (r["reason"], r["ocr"]) for r in E.extract(listing.read_jobs(jobs), ocr=reader).collect()}
    assert found == {"scan.pdf": (None, True), "unknown.bin": ("unsupported_format", False), "report.txt": (None, False)}


def test_registered_parser(spark):
    formats.register("txt2", lambda raw, _: ({}, [("paragraph", [("text", raw.decode().upper())])]))
    try:
        docs = E.extract(spark.createDataFrame([(1, bytearray(b"abc"), "txt2"), (2, None, "txt")], "doc_id long, content binary, format string"))
        assert {r["doc_id"]: (r["output"]) for r in render.rendered(docs).collect()} == {1: "ABC\n"}
        assert docs.where("doc_id = 2").first()["reason"] == "io_error"
    finally:
        del formats.EXTRACTORS["txt2"]


def test_text_documents_equal_the_parser(spark):
    texts = ["One\n\nTwo *x*\n\n\n# three ", "a\r\n\r\nb", "", None, " \n\n ", "- x\n\n1. y"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    native = {r["doc_id"]: r["output"] for r in render.rendered(E.text_documents(rows, "k", "t")).collect()}
    files = rows.select(F.col("k").alias("doc_id"), F.encode("t", "UTF-8").alias("content"), F.lit("txt").alias("format"))
    parsed = E.extract(files)
    assert native == {r["doc_id"]: r["output"] for r in render.rendered(parsed).collect()}
    blocks = lambda d: {r["doc_id"]: [tuple(b)[:5] + (json.loads(b["json"]),) for b in r["blocks"]] for r in d.where("reason is null").collect()}
    assert blocks(E.text_documents(rows, "k", "t")) == blocks(parsed)


# ---------------------------------------------------------------- chunking --

HANDBOOK = "# Handbook\n\nWelcome to the company. It is good.\n\n## Tools\n\nUse a hammer. " + "Long text goes on. " * 30 + "\n\n### Saws\n\nSharp.\n\n## Payroll\n\nMonthly é. " + "y" * 300


def markdown_docs(spark, *sources):
    rows = spark.createDataFrame([(k, bytearray(s.encode()), "markdown") for k, s in enumerate(sources)], "doc_id long, content binary, format string")
    return E.extract(rows)


@pytest.mark.parametrize(("size", "overlap"), [(40, 0), (120, 0), (120, 60), (800, 80), (0, 0), (1, 5), (100_000, 9)])
def test_chunk_invariants(spark, size, overlap):
    docs = markdown_docs(spark, HANDBOOK, "just one", "a\n\nb\n\nc\n\nd")
    whole = {r["doc_id"]: r["output"].encode() for r in render.rendered(docs).collect()}
    found = C.chunks(docs, size, overlap).orderBy("doc_id", "chunk_idx").collect()
    ends: dict = {}
    for r in found:
        a, b = r["byte_range"]
        assert whole[r["doc_id"]][a:b].decode() == r["text"]
        assert r["chunk_idx"] == ends.get(r["doc_id"], (0, -1))[1] + 1
        if not overlap:
            assert len(r["text"]) <= (size or C.SIZE)
            assert not whole[r["doc_id"]][ends.get(r["doc_id"], (0, -1))[0] : a].strip()
        ends[r["doc_id"]] = b, r["chunk_idx"]
    assert all(not whole[d][e:].strip() for d, (e, _) in ends.items()) and len(ends) == 3
    again = C.chunks(docs.repartition(5), size, overlap)
    assert sorted(r["hash"] for r in again.collect()) == sorted(r["hash"] for r in found)
    assert found[-1]["hash"] == again.where(F.col("hash") == T.content_hash(F.col("heading_path"), F.col("text"))).where(F.col("text") == found[-1]["text"]).first()["hash"]


def test_heading_paths_and_breaks(spark):
    found = C.chunks(markdown_docs(spark, HANDBOOK), 40).orderBy("chunk_idx").collect()
    assert found[0]["heading_path"] == ["Handbook"] and found[-1]["heading_path"] == ["Handbook", "Payroll"]
    big = C.chunks(markdown_docs(spark, "# A\n\nx\n\n## B\n\ny\n\n# C\n\nz"), 400).orderBy("chunk_idx").collect()
    assert [r["heading_path"] for r in big] == [["A"], ["C"]]
    assert C.cut_point("one. two three") == 4 and C.cut_point("\nabc") == 4 and C.cut_point("ab\ncd") == 3 and C.cut_point("abcd") == 4 and C.cut_point("a.b c") == 3
    assert C.pieces("x" * 10, 4) == [(0, 4), (4, 8), (8, 10)]


def test_chunk_sinks(spark):
    found = C.chunks(markdown_docs(spark, "# A\n\nbody text"), 400)
    r = found.first()
    label = f"chunk 1/1 | A | bytes 0-14 | {r['hash'][:19]}…"
    assert C.rendered(found, "md").first()["output"] == f"<!-- {label} -->\n\n# A\n\nbody text\n\n"
    assert C.rendered(found, "text").first()["output"].startswith(f"-- {label} --\n\n")
    assert json.loads(C.rendered(found, "json").first()["output"])["chunks"][0]["byte_range"] == [0, 14]


# -------------------------------------------------------------------- rest --

def test_layout_equals_the_parser(spark):
    glyphs = [(float(x), float(y), 10.0, float(x) + 5, c) for y, row in ((10, "Ab c"), (10.4, "z"), (30, "next-"), (42, "line")) for x, c in zip(range(0, 200, 6), row)]
    rows = spark.createDataFrame([(1, k, *g) for k, g in enumerate(glyphs)], "page int, tie int, x double, y double, size double, e double, t string")
    lines = L.assembled_lines(L.line_clusters(rows, "page", "y", "x", "size", "tie"), "page", "y", "x", "e", "size", "t", "tie")
    got = [(r["text"], r["x"], r["right"], r["y"], r["size"]) for r in lines.orderBy("line_no").collect()]
    assert got == pagelayout.lines(glyphs)
    spans = [(0, 10), (5, 20), (22, 30), (100, 120), (101, 140)]
    table = spark.createDataFrame([(1, float(a), float(b)) for a, b in spans], "page int, a double, b double")
    assert [(r["a"], r["b"]) for r in L.column_bounds(table, "page", "a", "b", F.lit(5.0)).orderBy("column_no").collect()] == pagelayout.column_bounds(spans, 5)


def test_stream_equals_batch(spark, inbox, tmp_path):
    target, mark = str(tmp_path / "chunks"), str(tmp_path / "mark")
    ingest.run_ingest(ingest.file_stream(spark, str(inbox)), target, mark).awaitTermination()
    batch = C.chunks(E.extract(listing.read_tree(spark, str(inbox)).select("doc_id", "content", "format")))
    key = lambda d: sorted((r["doc_id"], r["hash"]) for r in d.select("doc_id", "hash").collect())
    assert key(spark.read.parquet(target)) == key(batch)
    assert key(ingest.latest(spark, target)) == key(batch)
    assert ingest.changed(batch, batch).count() == 0
    ingest.run_ingest(ingest.file_stream(spark, str(inbox)), target, mark).awaitTermination()
    assert key(spark.read.parquet(target)) == key(batch)


def test_views(spark, inbox):
    api.register_views(spark, listing.read_tree(spark, str(inbox)))
    assert spark.sql("select count(*) n from chunks join documents using (doc_id) where reason is null").first()["n"] > len(ALL)
    assert spark.sql("select count(distinct type) n from blocks").first()["n"] >= 6
    assert spark.sql("select count(*) n from statuses where status = 'skipped'").first()["n"] == 3


def test_targets(spark):
    names = ["a.txt", "b/a.pdf", "b/a.docx", "x/.hidden", "noext", "c.tar.gz"]
    found = {r["relative"]: r["target"] for r in status.with_targets(spark.createDataFrame([(n,) for n in names], "relative string"), "md").collect()}
    assert found == {"a.txt": "a.md", "b/a.pdf": "b/a.pdf.md", "b/a.docx": "b/a.docx.md", "x/.hidden": "x/.hidden.md", "noext": "noext.md", "c.tar.gz": "c.tar.md"}
    ext = column(spark, names, D.extension)
    assert ext == ["txt", "pdf", "docx", None, None, "gz"]


# ----------------------------------------------------------------- queries --

DATA = "/root/testdata/sf0.001"


def same(a, b):
    rows = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).itertuples(index=False, name=None)))
    return sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the sample tables")
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_queries_equal_sql(spark, name):
    import duckdb

    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in catalogue.ORACLE:
        db = duckdb.connect()
        for t in ("nation", "region", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations"):
            db.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
        assert same(got, db.execute(catalogue.ORACLE[name]).df())


def test_plans(spark):
    if not os.path.isdir(DATA):
        pytest.skip("needs the sample tables")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    docs = catalogue.table(spark, DATA, "documents")
    text = plan(render.rendered(E.text_documents(docs, "doc_id", "text")))
    assert "Exchange" not in text and "Python" not in text and "MapInArrow" not in text
    chunked = plan(catalogue.QUERIES["chunks_full"](spark, DATA))
    assert "Exchange" not in chunked
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
