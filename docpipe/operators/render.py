"""Documents to Markdown, text and JSON: array functions over the blocks of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import rtrimu, yaml_string


def _joined(blocks: Column, field: str) -> Column:
    parts = F.filter(F.transform(blocks, lambda b: rtrimu(b[field])), lambda x: x != "")
    body = F.array_join(parts, "\n\n")
    return F.when(body != "", F.concat(body, F.lit("\n"))).otherwise("")


def text(blocks: Column) -> Column:
    return _joined(blocks, "txt")


def body(blocks: Column) -> Column:
    return _joined(blocks, "md")


def front_matter(meta: Column) -> Column:
    fields = [(k, yaml_string(meta[k])) for k in ("title", "author", "created", "language", "publisher")]
    fields += [("pages", meta["page_count"].cast("string")), ("format", yaml_string(meta["source_format"]))]
    lines = F.concat_ws("", *(F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit("\n"))) for k, v in fields))
    return F.when(lines != "", F.concat(F.lit("---\n"), lines, F.lit("---\n\n"))).otherwise("")


def markdown(blocks: Column, meta: Column | None = None) -> Column:
    """With front matter if meta is given."""
    return body(blocks) if meta is None else F.concat(front_matter(meta), body(blocks))


def json(blocks: Column, meta: Column) -> Column:
    """{"blocks": [...], "meta": {...}}; fields that are unset are absent from meta."""
    return F.concat(F.lit('{"blocks":['), F.array_join(F.transform(blocks, lambda b: b["json"]), ","), F.lit('],"meta":'), F.to_json(meta), F.lit("}"))


def rendered(docs: DataFrame, format: str = "md", metadata: bool = False) -> DataFrame:
    """(doc_id, output) of the documents that have text; output ends with a newline."""
    meta = F.col("meta")
    out = {
        "md": lambda: markdown(F.col("blocks"), meta if metadata else None),
        "text": lambda: text(F.col("blocks")),
        "json": lambda: F.concat(json(F.col("blocks"), meta), F.lit("\n")),
    }[format]()
    return docs.where("reason is null").select("doc_id", F.when(out.endswith("\n"), out).otherwise(F.concat(out, F.lit("\n"))).alias("output"))
