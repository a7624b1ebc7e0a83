"""Documents to retrieval chunks with heading paths, byte ranges and content hashes.

chunks() folds each row's blocks in one Arrow-batched pass: no shuffle, linear in the text.
Cutting is a fold whose state depends on the data, which SQL can only say quadratically, so the
queries' recursive SQL serves as a check alone. Hashes are computed by the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import WS, content_hash, py_one_line, short_hash

SIZE, OVERLAP, BATCH_CHARS = 800, 0, 4 << 20
CHUNK = "chunk_idx int, text string, heading_path array<string>, source string, byte_range array<bigint>"
_ENDS = re.compile(rf"[.!?…](?=[{WS}]|$)")
_SPACE = re.compile(f"[{WS}]")


def cut_point(window: str) -> int:
    """Behind the last line end, else the last sentence's end, else before the last space,
    else the window's end; nothing is cut before its second character."""
    at = window.rfind("\n")
    if at > 0:
        return at + 1
    for pattern, past in ((_ENDS, 1), (_SPACE, 0)):
        last = max((m.start() for m in pattern.finditer(window)), default=0)
        if last > 0:
            return last + past
    return len(window)


def pieces(text: str, size: int) -> list[tuple[int, int]]:
    """(start, end) of pieces of at most `size` characters, without the white space between."""
    if len(text) <= size:
        return [(0, len(text))]
    out, at = [], 0
    while len(text) - at > size:
        cut = at + cut_point(text[at : at + size])
        end = at + len(text[at:cut].rstrip(WS))
        if end > at:
            out.append((at, end))
        at = cut
        while at < len(text) and text[at] in WS:
            at += 1
    if at < len(text):
        out.append((at, len(text)))
    return out


def pack(segments: list[tuple], size: int) -> list[tuple[int, int]]:
    """Half-open groups of (start, end, chars, path, heading), greedily up to `size`; a heading
    opens a group if the one before is half full or its own path is shorter."""
    groups, start, chars = [], 0, 0
    for k, (begin, _, n, path, heading) in enumerate(segments):
        if k > start:
            gap = begin - segments[k - 1][1]
            if chars + gap + n > size or heading and (2 * chars >= size or len(path) < len(segments[k - 1][3])):
                groups.append((start, k))
                start, chars = k, 0
            else:
                chars += gap
        chars += n
    return groups + [(start, len(segments))] if start < len(segments) else groups


def segment(blocks: Iterable[tuple], size: int) -> tuple[str, list[tuple]]:
    """The Markdown of a document and its segments, in characters. blocks: (type, level, plain, md)."""
    shown, out, at = [], [], 0
    stack: list[tuple[int, str]] = []
    for kind, level, plain, md in blocks:
        md = md.rstrip(WS)
        if not md.strip(WS):
            continue
        heading = kind == "heading"
        if heading:
            level = min(6, max(1, level))
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, py_one_line(plain)))
        path = [t for _, t in stack]
        for k, (s, e) in enumerate(pieces(md, size)):
            out.append((at + s, at + e, e - s, path, heading and k == 0))
        shown.append(md)
        at += len(md) + 2
    return "\n\n".join(shown), out


def cut(blocks: Iterable[tuple], size: int, overlap: int) -> Iterator[tuple[str, list[str], int, int]]:
    """(text, heading path, first byte, byte behind the last) of each chunk."""
    size = max(size, 1)
    overlap = min(overlap, size // 2)
    text, segments = segment(blocks, size)
    bytes_before = seen = 0
    before = 0
    for first, end in pack(segments, size):
        start, taken = first, 0
        # Whole segments of the chunk before, never all of it: a gap counts with its segment.
        while before and start > before_first + 1:
            cost = segments[start][0] - segments[start - 1][0]
            if taken + cost > overlap:
                break
            taken, start = taken + cost, start - 1
        a, b = segments[start][0], segments[end - 1][1]
        own = text[a:b]
        # Bytes are counted once from left to right; an overlap steps back by its own bytes.
        low = bytes_before + len(text[seen:a].encode()) if a >= seen else bytes_before - len(text[a:seen].encode())
        yield own, segments[first][3], low, low + len(own.encode())
        bytes_before, seen = low + len(own.encode()), b
        before, before_first = 1, first


def chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, source: str | None = None) -> DataFrame:
    """(doc_id, chunk_idx, text, heading_path, source, byte_range, hash) for the documents that
    have text. size counts characters, byte_range bytes of the Markdown without front matter.
    A size of 0 means the default."""
    size = size or SIZE
    key = docs.schema["doc_id"]
    schema = StructType([key, *StructType.fromDDL(CHUNK).fields])
    arrow = to_arrow_schema(schema)
    where = F.col(source).cast("string") if source else F.col("meta.source_path")
    slim = F.transform("blocks", lambda b: F.struct(b["type"].alias("type"), b["level"].alias("level"), F.when(b["type"] == "heading", b["plain"]).alias("plain"), b["md"].alias("md")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0)).to_pylist()
            fields = list(zip(*(x.to_pylist() for x in lists.flatten().flatten())))
            row: list[int] = []
            out: tuple[list, ...] = ([], [], [], [])
            size_of = 0

            def full() -> pa.RecordBatch:
                at = pa.array(row, pa.int64())
                number, text, path, places = out
                columns = [batch.column(0).take(at), number, text, path, batch.column(1).take(at), places]
                return pa.record_batch([x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, arrow)], schema=arrow)

            for k, (low, high) in enumerate(zip([0, *ends], ends)):
                for n, (text, path, start, stop) in enumerate(cut(fields[low:high], size, overlap)):
                    row.append(k)
                    for column, value in zip(out, (n, text, path, [start, stop])):
                        column.append(value)
                    size_of += len(text)
                if size_of > BATCH_CHARS:
                    yield full()
                    row, out, size_of = [], ([], [], [], []), 0
            if row:
                yield full()

    found = docs.where("reason is null").select("doc_id", where.alias("source"), slim.alias("blocks")).mapInArrow(run, schema)
    return found.withColumn("hash", content_hash(F.col("heading_path"), F.col("text")))


# ---------------------------------------------------------------- sinks --

def rendered(found: DataFrame, format: str = "md") -> DataFrame:
    """(doc_id, output): all chunks of a document behind a header line each, or as JSON
    {"chunks", "source"}. One shuffle by document."""
    n = F.count("*").over(W.partitionBy("doc_id"))
    path = F.when(F.size("heading_path") > 0, F.array_join("heading_path", " > ")).otherwise("—")
    label = F.format_string(
        "chunk %d/%d | %s | bytes %d-%d | %s", F.col("chunk_idx") + 1, n, path, F.col("byte_range")[0], F.col("byte_range")[1], short_hash(F.col("hash")),
    )
    if format == "json":
        one = F.struct("text", "heading_path", "source", "byte_range", "hash")
        whole = F.array_sort(F.collect_list(F.struct("chunk_idx", one.alias("c"))))
        return found.groupBy("doc_id").agg(whole.alias("all"), F.first("source").alias("source")).select(
            "doc_id", F.concat(F.to_json(F.struct(F.transform("all", lambda x: x["c"]).alias("chunks"), "source")), F.lit("\n")).alias("output")
        )
    left, right = ("<!-- ", " -->\n\n") if format == "md" else ("-- ", " --\n\n")
    body = F.concat(F.lit(left), label, F.lit(right), F.regexp_replace("text", r"(?U)\s+$", ""), F.lit("\n\n"))
    lines = found.select("doc_id", "chunk_idx", body.alias("body"))
    return lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "body"))).alias("all")).select(
        "doc_id", F.array_join(F.transform("all", lambda x: x["body"]), "").alias("output")
    )
