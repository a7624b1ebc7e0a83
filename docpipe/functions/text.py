"""String scalars, each as a Column expression and, where parsers need it, as a Python twin.

White space means the 25 code points of Unicode's White_Space property everywhere: Java's \\s
under (?U), and WS in Python (str.strip() would also take the four separators U+001C to U+001F).
"""

from __future__ import annotations

import re

import regex
from pyspark.sql import Column, functions as F

WS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{WS}]+")
_LONE_UNDERSCORE = regex.compile(r"(?<![\p{Alphabetic}\p{N}])_|_(?![\p{Alphabetic}\p{N}])")
_PERCENT = re.compile(rb"%([0-9a-fA-F]{2}|\+[0-9a-fA-F])")
_MARKUP = re.compile(r"([\\`*\[\]<])")
_LEADING = re.compile(f"^([{WS}]*)(?=[#>|]|[-+] |[0-9]+[.)] )")


# ------------------------------------------------------------------ Column --

def trimu(x: Column) -> Column:
    """Trimmed of Unicode white space (Spark's trim takes U+0020 only)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def rtrimu(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+$", "")


def squeeze(x: Column) -> Column:
    """Runs of white space to one space, edges kept."""
    return F.regexp_replace(x, r"(?U)\s+", " ")


def one_line(x: Column) -> Column:
    return F.trim(squeeze(x))


def escape_markdown(x: Column) -> Column:
    marked = F.regexp_replace(x, r"([\\`*\[\]<])", r"\\$1")
    return F.regexp_replace(marked, r"(?<![\p{IsAlphabetic}\p{N}])_|_(?![\p{IsAlphabetic}\p{N}])", r"\\_")


def escape_leading(x: Column) -> Column:
    """A backslash before what would make the paragraph a heading, quote, table or list."""
    return F.regexp_replace(x, r"(?U)^(\s*)(?=[#>|]|[-+] |[0-9]+[.)] )", r"$1\\")


def escape_href(x: Column) -> Column:
    wrapped = F.concat(F.lit("<"), F.replace(x, F.lit(">"), F.lit("%3E")), F.lit(">"))
    return F.when(x.rlike("[ ()]"), wrapped).otherwise(x)


def yaml_string(x: Column) -> Column:
    quoted = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), quoted, F.lit('"'))


def longest_backticks(x: Column) -> Column:
    return F.array_max(F.transform(F.split(x, "[^`]"), F.length))


def code_fence(lang: Column, code: Column) -> Column:
    fence = F.repeat(F.lit("`"), F.greatest(longest_backticks(code), F.lit(2)) + 1)
    return F.concat(fence, F.coalesce(lang, F.lit("")), F.lit("\n"), rtrimu(code), F.lit("\n"), fence)


def short_hash(x: Column) -> Column:
    """The algorithm and the first twelve digits."""
    body = F.substring_index(x, ":", -1)
    short = F.concat(F.substring_index(x, ":", 1), F.lit(":"), F.substring(body, 1, 12), F.lit("…"))
    return F.when(x.contains(":") & (F.length(body) > 12), short).otherwise(x)


def resolve_path(base: Column, href: Column) -> Column:
    """base + href without query and fragment, with "." and ".." worked out."""
    parts = F.split(F.concat(base, F.regexp_replace(href, "[#?].*$", "")), "/")
    walked = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when(p.isin("", "."), acc)
        .when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(walked, "/")


def content_hash(path: Column, text: Column) -> Column:
    """sha-256 over the heading path and the text, told apart by separators."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.array_join(path, "\x1f"), F.lit("\x1e"), text), 256))


# ------------------------------------------------------------------ Python --

def py_one_line(text: str) -> str:
    return text if text.isalnum() else _RUN.sub(" ", text).strip(" ")


def py_squeeze(text: str) -> str:
    return _RUN.sub(" ", text)


def py_escape_markdown(text: str) -> str:
    if text.isalnum():
        return text
    text = _MARKUP.sub(r"\\\1", text)
    return _LONE_UNDERSCORE.sub(r"\\_", text) if "_" in text else text


def py_escape_leading(text: str) -> str:
    return _LEADING.sub(r"\1\\", text, count=1)


def py_escape_href(href: str) -> str:
    return "<" + href.replace(">", "%3E") + ">" if any(c in href for c in " ()") else href


def py_longest_backticks(text: str) -> int:
    return max(map(len, re.findall("`+", text)), default=0)


def py_natural_key(name: str) -> list[tuple]:
    return [(0, int(p), "") if p[0] in "0123456789" else (1, 0, p) for p in re.findall(r"[0-9]+|[^0-9]+", name)]


def py_percent_decode(text: str) -> str:
    """%XX to bytes, all else as it is; a plus stays. Two bytes must follow the percent sign."""
    if "%" not in text:
        return text
    return _PERCENT.sub(lambda m: bytes([int(m[1].lstrip(b"+"), 16)]), text.encode()).decode("utf-8", "replace")


def py_resolve(base: str, href: str) -> str:
    kept: list[str] = []
    for part in (base + py_percent_decode(re.split("[#?]", href, maxsplit=1)[0])).split("/"):
        if part == "..":
            del kept[-1:]
        elif part not in ("", "."):
            kept.append(part)
    return "/".join(kept)
