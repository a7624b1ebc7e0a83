"""Chat transcripts from an event log.

Events (conv_id, turn, seq, kind, role, text), kind one of
  message     the turn starts as this text
  delta       the text is appended to the turn
  edit        the turn's text is replaced; later deltas append to it
  regenerate  the turn starts again as this text; role is taken from it as well
  delete      the turn is dropped, unless a later event starts it again
Events of a turn apply by seq, ties by kind in the order above and then by role and text. An
event that repeats another in every column is applied once, so redelivered logs do no harm.

Rendering: turns in order, each as <|role|>, newline, text, newline, <|end|>, newline. No text can
forge a delimiter: where it has "<", any backslashes and "|", one more backslash goes before the
"|", so each text can be read back; of a role, characters but letters, digits, "_", "." and "-"
show as "_".
Defined results: events without conv_id or turn are dropped; null seq sorts first; null text
is empty, null role is "user"; an unknown or null kind is a message; turns whose text is
empty stay; a conversation without turns left gives no row; further columns are ignored; an
empty log gives no rows; texts may be of any length. All of it is window and aggregate functions: one shuffle by conv_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

KINDS = ("message", "delta", "edit", "regenerate", "delete")


def log_of_messages(messages: DataFrame) -> DataFrame:
    """The event log of a table (conv_id, turn, role, text): an assistant's lines were
    streamed as deltas after an empty message, all else came at once. Of rows for one turn
    the later ones, by role and text, regenerate it."""
    turn = W.partitionBy("conv_id", "turn").orderBy("role", "text")
    m = messages.select(
        messages["conv_id"].cast("long").alias("conv_id"), messages["turn"].cast("long").alias("turn"),
        messages["role"].cast("string").alias("role"), messages["text"].cast("string").alias("text"),
    )
    m = m.withColumn("version", F.row_number().over(turn))
    lines = F.split(F.coalesce("text", F.lit("")), "(?<=\n)")
    whole = F.array(F.struct(F.coalesce("text", F.lit("")).alias("text")))
    first = F.when(F.col("version") > 1, "regenerate").otherwise("message")
    streamed = F.concat(F.array(F.struct(F.lit("").alias("text"))), F.transform(lines, lambda x: F.struct(x.alias("text"))))
    parts = F.when(F.col("role") == "assistant", streamed).otherwise(whole)
    return m.select("conv_id", "turn", "role", "version", first.alias("first"), F.posexplode(parts).alias("part", "piece")).select(
        "conv_id", "turn", (F.col("version").cast("long") * (1 << 32) + F.col("part")).alias("seq"),
        F.when(F.col("part") == 0, F.col("first")).otherwise("delta").alias("kind"), "role", F.col("piece.text").alias("text"),
    )


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after all events."""
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("message")
    e = events.select(
        events["conv_id"].cast("long").alias("conv_id"), events["turn"].cast("long").alias("turn"),
        events["seq"].cast("long").alias("seq"), kind.alias("kind"),
        F.coalesce(events["role"].cast("string"), F.lit("user")).alias("role"),
        F.coalesce(events["text"].cast("string"), F.lit("")).alias("text"),
    ).where("conv_id is not null and turn is not null")
    # Partitioning by the conversation alone serves every step, down to the rendering.
    e = e.repartition("conv_id")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    e = e.withColumn("k", order)
    same = W.partitionBy("conv_id", "turn").orderBy("seq", "k", "role", "text")
    sort = ("seq", "k", "role", "text")
    e = e.withColumn("again", F.lag(F.struct(*sort)).over(same)).where(
        F.col("again").isNull() | ~F.col("again").eqNullSafe(F.struct(*sort))
    )
    starts = F.col("kind") != "delta"
    upto = same.rowsBetween(W.unboundedPreceding, W.currentRow)
    opens = F.col("kind").isin("message", "regenerate")
    e = (
        e.withColumn("epoch", F.sum(F.when(starts, 1).otherwise(0)).over(upto))
        .withColumn("speaker", F.coalesce(F.last(F.when(opens, F.col("role")), True).over(upto), F.first("role").over(upto)))
        .withColumn("last", F.max("epoch").over(W.partitionBy("conv_id", "turn")))
        .where("epoch = last")
    )
    turns = e.groupBy("conv_id", "turn").agg(
        F.array_sort(F.collect_list(F.struct(*sort))).alias("parts"),
        F.max_by("speaker", F.struct(*sort)).alias("role"),
        F.max(F.when(F.col("kind") == "delete", 1).otherwise(0)).alias("gone"),
    )
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return turns.where("gone = 0").select("conv_id", "turn", "role", joined.alias("text"))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered), one row for each conversation."""
    role = F.regexp_replace("role", "[^A-Za-z0-9_.-]", "_")
    text = F.regexp_replace("text", r"<(\\*)\|", r"<\\$1|")
    one = F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))
    return (
        turns.select("conv_id", "turn", one.alias("one"))
        .groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "one"))).alias("all"))
        .select("conv_id", F.size("all").cast("long").alias("n_turns"), F.array_join(F.transform("all", lambda x: x["one"]), "").alias("rendered"))
    )


ORACLE = r"""
with m as (
  select conv_id, turn, coalesce(role, 'user') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id, turn order by role desc, text desc) as back
  from conversations where conv_id is not null and turn is not null
)
select conv_id, count(*) as n_turns,
       string_agg('<|' || regexp_replace(role, '[^A-Za-z0-9_.-]', '_', 'g') || '|>' || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || chr(10) || '<|end|>' || chr(10), '' order by turn) as rendered
from m where back = 1 group by conv_id
"""
