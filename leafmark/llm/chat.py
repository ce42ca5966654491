"""Chat formatting with a grammar round trip, in DataFrame expressions only.

A conversation is rendered as `<|im_start|>role LF text <|im_end|> LF` per turn, then reparsed by the deterministic parser
`parsed`. Where the recovered turns differ from the source, control strings inside the conversation's roles and texts are
escaped and it is rendered again; the escape is reversible, so the second round is identical.

The escape puts a backslash into each `<|`, behind any backslashes that already stand there: `<|` becomes `<\\|`, `<\\|` becomes
`<\\\\|`; the parser takes one away. Line feeds in roles become `<|nl|>`. Offsets of the loss mask count code points.

Defined results: null roles and texts are empty; rows of one conversation are ordered by turn, then role, then text, null
turns first; repeated rows are turns of their own; rows with a null conv_id form one conversation; an empty table gives no
rows; further columns are ignored. A conversation is one output row, so its text must fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
CLOSE = f"{END}\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _parts(turns: Column, hard: bool) -> Column:
    """Each turn as it is written: head (up to the line feed), body."""

    def part(t: Column) -> Column:
        role = F.replace(escaped(t["role"]), F.lit("\n"), F.lit(LINE)) if hard else t["role"]
        return F.struct(F.concat(F.lit(START), role, F.lit("\n")).alias("head"), (escaped(t["text"]) if hard else t["text"]).alias("body"), t["role"].alias("role"))

    return F.transform(turns, part)


def rendered(turns: Column, hard: bool) -> Column:
    return F.concat(F.array_join(F.transform(_parts(turns, hard), lambda p: F.concat(p["head"], p["body"])), CLOSE), F.when(F.size(turns) > 0, CLOSE).otherwise(""))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role, text. A turn that the grammar doesn't allow has neither.

    Every end mark ends a turn, a line feed and a start mark begin one, and no other start mark may stand inside.
    """
    opening = f"\n{START}"
    pieces = F.split(F.concat(F.lit("\n"), formatted), r"<\|im_end\|>", -1)

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, len(opening) + 1, F.length(piece))
        role = F.substring_index(inner, "\n", 1)
        sound = F.startswith(piece, F.lit(opening)) & ~F.contains(inner, F.lit(START))
        plain = unescaped(F.replace(role, F.lit(LINE), F.lit("\n")))
        text = unescaped(F.substring(inner, F.length(role) + 2, F.length(inner)))
        return F.struct(F.when(sound, plain).alias("role"), F.when(sound, text).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def format_conversations(rows: DataFrame, learn: str = "assistant") -> DataFrame:
    """rows(conv_id, turn, role, text) as conv_id, formatted, escaped, round_trip, loss_spans (start, length of each `learn` text)."""
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    grouped = plain.groupBy("conv_id").agg(turns.alias("turns"))
    first = grouped.withColumn("soft", rendered(F.col("turns"), False)).withColumn("escaped", parsed(F.col("soft")) != F.col("turns"))
    final = first.withColumn("formatted", F.when(F.col("escaped"), rendered(F.col("turns"), True)).otherwise(F.col("soft")))
    parts = F.when(F.col("escaped"), _parts(F.col("turns"), True)).otherwise(_parts(F.col("turns"), False))
    # a place before each body, from the lengths of all that is written before it
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        span = F.array(F.struct(start.alias("start"), F.length(p["body"]).alias("length")))
        return F.struct((start + F.length(p["body"]) + len(CLOSE)).alias("at"), F.when(p["role"] == learn, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(parts, zero, step)["spans"]
    return final.select("conv_id", "formatted", "escaped", (parsed(F.col("formatted")) == F.col("turns")).alias("round_trip"), spans.alias("loss_spans"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, nothing between its spans."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["length"]))), "")
