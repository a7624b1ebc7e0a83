"""Page layout as window functions over tables of glyphs, lines and intervals. One shuffle by
page serves every step, and no step collects a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.values import half_points


def line_clusters(glyphs: DataFrame, page: str, y: str, x: str, size: str, tie: str) -> DataFrame:
    """Adds line_no, from 0: glyphs in (y, x) order stay on the line of the one before if they
    are within half the larger size of it."""
    order = W.partitionBy(page).orderBy(y, x, tie)
    new = F.abs(F.col(y) - F.lag(y).over(order)) > F.greatest(F.lag(size).over(order), F.col(size)) * 0.5
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    return glyphs.withColumn("__new", F.when(new, 1).otherwise(0)).withColumn("line_no", F.sum("__new").over(upto)).drop("__new")


def assembled_lines(glyphs: DataFrame, page: str, y: str, x: str, end: str, size: str, text: str, tie: str) -> DataFrame:
    """(page, line_no, text, x, right, y, size) of clustered glyphs: a space goes in where the
    gap exceeds a fifth of the size and none is there."""
    one = F.struct(F.col(x).alias("x"), F.col(tie).alias("tie"), F.col(end).alias("e"), F.col(size).alias("s"), F.col(text).alias("t"), F.col(y).alias("y"))
    rows = glyphs.groupBy(page, "line_no").agg(F.array_sort(F.collect_list(one)).alias("g"))
    joined = F.aggregate(
        "g", F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("end")),
        lambda acc, g: F.struct(
            F.concat(acc["text"], F.when((g["x"] > acc["end"] + g["s"] * 0.2) & ~acc["text"].endswith(" ") & ~g["t"].startswith(" "), " ").otherwise(""), g["t"]).alias("text"),
            g["e"].cast("double").alias("end"),
        ),
        lambda acc: acc["text"],
    )
    return rows.select(
        page, "line_no", F.regexp_replace(joined, r"(?U)^\s+|\s+$", "").alias("text"), F.col("g")[0]["x"].alias("x"),
        F.array_max(F.transform("g", lambda g: g["e"])).alias("right"), F.col("g")[0]["y"].alias("y"),
        F.greatest(F.lit(1.0), F.array_max(F.transform("g", lambda g: g["s"]))).alias("size"),
    ).where("text <> ''")


def paragraph_breaks(lines: DataFrame, region: str, y: str, right: str, size: str, tie: str) -> DataFrame:
    """Adds paragraph_no, from 0: a line opens one after a gap of 1.8 sizes, after a line that
    stops two sizes short of the region's edge, or when the size changes by a fifth."""
    own = W.partitionBy(region)
    order = own.orderBy(y, tie)
    before = {c: F.lag(c).over(order) for c in (y, right, size)}
    new = (
        (F.col(y) - before[y] > before[size] * 1.8)
        | (before[right] < F.max(right).over(own) - before[size] * 2.0)
        | (F.abs(F.col(size) - before[size]) > before[size] * 0.2)
    )
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    return lines.withColumn("__new", F.when(new, 1).otherwise(0)).withColumn("paragraph_no", F.sum("__new").over(upto)).drop("__new")


def _islands(spans: DataFrame, page: str, apart: Column) -> DataFrame:
    """Merges (page, a, b, ...) whose `apart` from the furthest end before isn't true."""
    order = W.partitionBy(page).orderBy("a", "b")
    marked = spans.withColumn("reach", F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1)))
    marked = marked.withColumn("new", F.when(F.col("reach").isNull() | apart, 1).otherwise(0))
    return marked.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))


def column_bounds(spans: DataFrame, page: str, start: str, end: str, body: Column) -> DataFrame:
    """(page, column_no, a, b): intervals merged where they overlap, then across gaps narrower
    than a gutter, which is 4 % of the width or twice the body size, whichever is more."""
    rows = spans.select(page, F.col(start).alias("a"), F.col(end).alias("b"), body.alias("body"))
    ends = [F.min("a").alias("a"), F.max("b").alias("b"), F.max("body").alias("body")]
    joined = _islands(rows, page, F.col("a") > F.col("reach")).groupBy(page, "island").agg(*ends)
    own = W.partitionBy(page)
    # As the last merged span is also the rightmost, the page's width is the largest end's.
    joined = joined.select(page, "a", "b", "body", (F.max("b").over(own) - F.min("a").over(own)).alias("width"))
    gutter = F.greatest(F.col("width") * 0.04, F.col("body") * 2.0)
    final = _islands(joined, page, F.col("a") - F.col("reach") >= gutter).groupBy(page, "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return final.select(page, (F.col("island") - 1).cast("int").alias("column_no"), "a", "b")


def in_columns(glyphs: DataFrame, bounds: DataFrame, page: str, x: str) -> DataFrame:
    """Adds column_no of the bounds that hold x, 0 for what stands in a gutter: an equi-join by
    page whose range condition is checked within the page."""
    inside = (F.col(x) >= F.col("__a")) & (F.col(x) <= F.col("__b"))
    own = bounds.select(F.col(page).alias("__page"), F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("column_no"))
    joined = glyphs.join(own, (F.col(page) == F.col("__page")) & inside, "left")
    return joined.withColumn("column_no", F.coalesce("column_no", F.lit(0))).drop("__page", "__a", "__b")


def kept_baselines(values: Column, tolerance: Column) -> Column:
    """Of sorted values those that differ from the last kept one by the tolerance at least."""
    return F.aggregate(
        F.array_sort(values), F.array().cast("array<double>"),
        lambda acc, v: F.when((F.size(acc) > 0) & (F.abs(v - F.element_at(acc, -1)) < tolerance), acc).otherwise(F.concat(acc, F.array(v.cast("double")))),
    )


def upper_median(x: str) -> Column:
    """The aggregate sizes[n div 2] of sorted sizes."""
    sizes = F.sort_array(F.collect_list(x))
    return F.element_at(sizes, F.floor(F.size(sizes) / 2).cast("int") + 1)


def body_sizes(lines: DataFrame, page: str, size: str, chars: str, order: str) -> DataFrame:
    """(page, body_size): the half-point size of most characters, of equals the one that came
    up last."""
    per = lines.groupBy(page, half_points(F.col(size)).alias("key")).agg(F.sum(chars).alias("n"), F.min(order).alias("first"))
    return per.groupBy(page).agg(F.max_by("key", F.struct("n", "first")).alias("body_size"))
