"""Row types of documents, blocks, chunks and statuses."""

from __future__ import annotations

TOKEN = "struct<op: string, value: string, href: string>"
SPANS = f"array<{TOKEN}>"
CELLS = f"array<{SPANS}>"
META = "struct<title: string, author: string, created: string, language: string, publisher: string, page_count: int, source_format: string, source_path: string>"
SLIM = "struct<type: string, level: int, plain: string, md: string, txt: string, json: string>"
FULL = (
    "struct<block_idx: int, parent_idx: int, item_no: int, depth: int, type: string, level: int, ordered: boolean, lang: string, page: int, code: string, alt: string, "
    f"spans: {SPANS}, header: {CELLS}, rows: array<{CELLS}>, plain: string, md: string, txt: string>"
)
META_FIELDS = ("title", "author", "created", "language", "publisher", "page_count")
