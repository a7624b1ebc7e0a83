"""The look-ups inside documents as joins, for parts that live in tables: relationship ids,
numbering definitions. None is broadcast by hand; Catalyst picks the
strategy from the sizes it knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def lookup_last(rows: DataFrame, table: DataFrame, keys: list[str], value: str, order: str, default: str | None = None) -> DataFrame:
    """rows with `value` of the table's last entry of the same keys, else the default."""
    last = table.groupBy(*keys).agg(F.max_by(value, order).alias(value))
    joined = rows.join(last, keys, "left")
    return joined if default is None else joined.withColumn(value, F.coalesce(value, F.lit(default)))


def ordered_lists(items: DataFrame, nums: DataFrame, abstracts: DataFrame) -> DataFrame:
    """items (num_id, level, ...) with ordered, by way of nums (num_id, abstract_id) and
    abstracts (abstract_id, level, format); without an entry a list is a bulleted one."""
    ordered = ~F.col("format").isin("bullet", "none")
    formats = nums.join(abstracts, "abstract_id").select("num_id", "level", ordered.alias("ordered")).groupBy("num_id", "level").agg(F.bool_or("ordered").alias("ordered"))
    return items.join(formats, ["num_id", "level"], "left").withColumn("ordered", F.coalesce("ordered", F.lit(False)))
