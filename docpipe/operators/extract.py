"""Raw documents to documents with blocks.

A document is one row and its blocks are an array in it, so nothing from here to the rendered
text or the chunks needs a shuffle. Plain text never leaves the JVM; formats with a byte grammar
pass through one mapInArrow stage that parses and renders batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import blocks as B
from ..functions.text import escape_leading, escape_markdown, rtrimu, trimu
from ..schema import FULL, META, META_FIELDS, SLIM
from ..sources import formats
from ..sources.detect import HEAD, by_signature

BATCH_BYTES = 8 << 20


def extract(files: DataFrame, pages: str | None = None, full: bool = False, ocr=None, fields: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, meta, blocks, reason, message, ocr) for each row of (doc_id, content, format);
    further columns stay. reason is null for a document, else one of REASONS, and then blocks
    is null. full: blocks as pre-order rows with spans, else only the top level.
    fields: those of a block's row that are wanted, all if there are none.

    ocr: bytes to bytes of a searchable PDF, tried on inputs without text or of no supported
    format. It can add a document, never a failure: if it fails the first verdict stands.
    A null content is an io_error, as is a row whose `error` column says something.
    """
    chosen = formats.page_range(pages) if pages else None
    extractors = dict(formats.EXTRACTORS)
    keep = [f for f in files.schema.fields if f.name != "content"]
    row_type = StructType.fromDDL((FULL if full else SLIM).removeprefix("struct<").removesuffix(">"))
    fields = fields or tuple(row_type.names)
    row_type = StructType([row_type[k] for k in fields])
    schema = StructType(keep + StructType.fromDDL(f"meta {META}, blocks array<{row_type.simpleString()}>, reason string, message string, ocr boolean").fields)
    arrow = to_arrow_schema(schema)
    rows_of = B.flat if full else B.slim
    broken = F.col("error").isNotNull() if "error" in files.columns else F.lit(False)
    # A copied timestamp or nested column would cost a conversion in each task: plain types only.
    source = files.select(*(f.name for f in keep), F.when(~broken, F.col("content")).alias("content"))

    def one(row: dict) -> dict:
        raw, kind = row.pop("content"), row.get("format")
        out = row | {"meta": None, "blocks": None, "reason": None, "message": None, "ocr": False}
        try:
            if raw is None:
                raise formats.Failure("io_error", row.get("error") or "cannot be read")
            try:
                meta, blocks = formats.extract(kind, raw, chosen, extractors)
            except formats.Failure as e:
                if ocr is None or e.reason not in ("no_text_layer", "unsupported_format"):
                    raise
                try:
                    meta, blocks = formats.extract("pdf", ocr(raw), chosen, extractors)
                except Exception:
                    raise e from None
                out["ocr"] = True
        except formats.Failure as e:
            return out | {"reason": e.reason, "message": e.message}
        about = {k: meta.get(k) for k in META_FIELDS} | {"source_format": kind, "source_path": str(row["doc_id"])}
        return out | {"meta": about, "blocks": rows_of(blocks, fields)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        size = 0
        for batch in batches:
            for row in (row for k in range(0, batch.num_rows, 16) for row in batch.slice(k, 16).to_pylist()):
                size += len(row["content"] or b"")
                done.append(one(row))
                if size > BATCH_BYTES or len(done) >= 256:
                    yield pa.RecordBatch.from_pylist(done, arrow)
                    done, size = [], 0
        if done:
            yield pa.RecordBatch.from_pylist(done, arrow)

    return source.mapInArrow(run, schema)


def html_documents(pages: DataFrame, key: str, html: str, full: bool = False) -> DataFrame:
    """Documents of a table of web pages; the text is taken as HTML whatever it looks like."""
    content = F.encode(F.col(html).cast("string"), "UTF-8")
    return extract(pages.select(F.col(key).alias("doc_id"), content.alias("content"), F.lit("html").alias("format")), full=full)


def _paragraph(p: Column) -> Column:
    shown = escape_leading(escape_markdown(p))
    quoted = F.to_json(F.struct(
        F.array(F.struct(F.lit("text").alias("type"), p.alias("value"))).alias("text"), F.lit("paragraph").alias("type"),
    ))
    return F.struct(
        F.lit("paragraph").alias("type"), F.lit(None).cast("int").alias("level"), p.alias("plain"),
        rtrimu(shown).alias("md"), p.alias("txt"), quoted.alias("json"),
    )


def paragraphs_of(x: Column) -> Column:
    """Array of the paragraphs of plain text."""
    parts = F.filter(F.transform(F.split(x, "\n\n"), trimu), lambda p: p != "")
    return F.transform(parts, lambda p: F.replace(p, F.lit("\r\n"), F.lit("\n")))


def text_documents(table: DataFrame, key: str, text: str) -> DataFrame:
    """Documents of a table of plain texts, in the JVM alone. Null and blank texts have the
    reason no_text_layer."""
    found = table.select(F.col(key).alias("doc_id"), F.transform(paragraphs_of(F.coalesce(F.col(text).cast("string"), F.lit(""))), _paragraph).alias("blocks"))
    blank = F.size("blocks") == 0
    about = [F.lit(None).cast("int" if k == "page_count" else "string").alias(k) for k in META_FIELDS]
    about += [F.lit("txt").alias("source_format"), F.col("doc_id").cast("string").alias("source_path")]
    return found.select(
        "doc_id", F.when(~blank, F.struct(*about)).alias("meta"), F.when(~blank, F.col("blocks")).alias("blocks"),
        F.when(blank, "no_text_layer").alias("reason"), F.when(blank, "no extractable text").alias("message"), F.lit(False).alias("ocr"),
    )


def table_markdown(table: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(markdown) of a whole table, one row: columns padded to their widest cell. Widths and
    rows come from one pass each; the text of the table must fit one row, as in a document."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")).alias(c) for c in columns]
    rows = table.select(F.col(key).alias("__key"), *cells)
    widths = rows.agg(*(F.greatest(F.lit(3), F.lit(len(c)), F.coalesce(F.max(F.length(c)), F.lit(0))).alias(f"w_{c}") for c in columns))
    line = lambda values: F.concat(F.lit("| "), F.concat_ws(" | ", *(F.rpad(v, F.col(f"w_{c}"), F.lit(" ")) for v, c in zip(values, columns))), F.lit(" |"))
    body = rows.crossJoin(F.broadcast(widths)).select("__key", line([F.col(c) for c in columns]).alias("line"))
    joined = body.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__key", "line"))), lambda x: x["line"]), "\n").alias("body"))
    rule = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.repeat(F.lit("-"), F.col(f"w_{c}")) for c in columns)), F.lit(" |"))
    return widths.select(line([F.lit(c) for c in columns]).alias("head"), rule.alias("rule")).crossJoin(joined).select(
        F.concat_ws("\n", "head", "rule", F.when(F.col("body") != "", F.col("body"))).alias("markdown")
    )


def detected(raw: DataFrame, head: str = "content") -> Column:
    return by_signature(F.substring(F.col(head), 1, HEAD))
