"""Chat formatting by relational operators only: one training text per conversation, with its loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of the template. Texts and roles never contain ``#`` or ``<`` once escaped.
HEAD, AFTER_ROLE, END_TURN = "### ", ": ", " </turn>"


def escape(text: Column) -> Column:
    """Replace the lead characters of all control strings (and the backslash) reversibly."""
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#"))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def format_conversations(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans`` from ``conv_id, turn, role, text``.

    Turns are sorted by ``turn`` (null first), then role and text, so that ties and repeated rows have
    one defined order; each row is a turn of its own. Adjacent turns of one role share one header;
    every turn keeps its own end mark, so merging loses nothing. Null text or role counts as empty; a
    null ``conv_id`` is a conversation of its own; no rows give no rows; other columns are ignored.
    ``loss_spans`` are ``(start, length)`` in code points of ``formatted``, one per text of the role ``learn``.

    Rows meet once, by conversation: the window over a conversation and the collected turn structs use
    one shuffle. A conversation is one output text, so its rows have to meet in one task.
    """
    rows = turns.select("conv_id", F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("same", F.coalesce(F.lag("role").over(order) == F.col("role"), F.lit(False))).withColumn("at", F.row_number().over(order))
    rows = rows.withColumn("body", escape("text")).withColumn("head", F.when(F.col("same"), F.lit("")).otherwise(F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit(AFTER_ROLE))))
    size = F.length("head") + F.length("body") + F.lit(len(END_TURN))
    rows = rows.withColumn("stop", F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("start", F.col("stop") - F.lit(len(END_TURN)) - F.length("body"))
    turn = F.struct("at", "head", "body", "start", F.length("body").cast("long").alias("size"), (F.col("role") == learn).alias("learn"))
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return got.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END_TURN))), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["size"].alias("length"))).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns`` (array of role and text) parsed from ``formatted`` alone, and the learnt texts by the mask.

    ``masked`` holds the unescaped text under each loss span, in order.
    """
    parts = F.filter(F.split("formatted", HEAD, -1), lambda s: s != "")
    role = lambda s: unescape_role(F.substring_index(s, AFTER_ROLE, 1))
    body = lambda s: F.substr(s, F.instr(s, AFTER_ROLE) + F.lit(len(AFTER_ROLE)))
    bodies = lambda s: F.slice(F.split(body(s), END_TURN, -1), F.lit(1), F.size(F.split(body(s), END_TURN, -1)) - 1)
    turns = F.flatten(F.transform(parts, lambda s: F.transform(bodies(s), lambda b: F.struct(role(s).alias("role"), unescape(b).alias("text")))))
    masked = F.transform("loss_spans", lambda p: unescape(F.substr(F.col("formatted"), (p["start"] + 1).cast("int"), p["length"].cast("int"))))
    return formatted.select("*", turns.alias("turns"), masked.alias("masked"))
