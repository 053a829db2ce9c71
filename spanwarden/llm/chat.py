"""Chat formatting in Spark expressions.

Turn structs are collected per conversation and sorted; adjacent turns of one role become one block
whose texts are joined; the blocks are concatenated under this template:

    <s>[INST]role[/INST]text[NEXT]text</s><s>[INST]...

Control strings inside roles and texts get a backslash after their first character (one more than
they have), which ``unescaped`` takes away again, so the turns can be read back exactly. The loss
mask covers the assistants' texts, without markers.

Defined results: a null text or role is empty; turns are ordered by turn, role, text, a null turn
first; repeated rows stay; a null conv_id is a conversation of its own; an empty table gives an empty one;
extra columns are ignored. One conversation is one row and must fit one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwarden.llm.common import quoted

OPEN, MID, NEXT, CLOSE = "<s>[INST]", "[/INST]", "[NEXT]", "</s>"
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]|NEXT\]))"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]|NEXT\]))"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"$1$2$3")


def conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns array<struct<turn, role, text>>) in order."""
    one = F.struct(F.col(quoted(turn)).alias("turn"), F.coalesce(F.col(quoted(role)), F.lit("")).alias("role"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    return rows.groupBy(F.col(quoted(conv_id)).alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))


def formatted(rows: DataFrame, **names: str) -> DataFrame:
    """(conv_id, formatted, loss_spans array<struct<start, end>> in code points)."""
    turns = F.col("turns")
    starts = lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"])
    lead = lambda t, i: F.when(starts(i), F.concat(F.when(i > 0, F.lit(CLOSE)).otherwise(F.lit("")), F.lit(OPEN), escaped(t["role"]), F.lit(MID))).otherwise(F.lit(NEXT))
    pieces = F.transform(turns, lambda t, i: F.struct(lead(t, i).alias("lead"), escaped(t["text"]).alias("body"), (t["role"] == LEARNED).alias("learned")))
    df = conversations(rows, **names).select("conv_id", pieces.alias("pieces"))
    text = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["body"])), ""), F.lit(CLOSE))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["lead"])
        end = start + F.length(p["body"])
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(p["learned"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return df.select("conv_id", text.alias("formatted"), F.aggregate("pieces", zero, step)["spans"].alias("loss_spans"))


def turns_of(text: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    blocks = F.filter(F.split(text, CLOSE, -1), lambda b: b != "")

    def parsed(block: Column) -> Column:
        halves = F.split(F.substring(block, len(OPEN) + 1, 1 << 30), r"\[/INST\]", 2)
        return F.transform(F.split(halves[1], r"\[NEXT\]", -1), lambda t: F.struct(unescaped(halves[0]).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, parsed))


def learned_text(text: Column, spans: Column) -> Column:
    """What the loss mask covers, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(text, s["start"] + 1, s["end"] - s["start"]))), "")


def read_back(chats: DataFrame) -> DataFrame:
    """The digest columns, from the formatted text and its mask alone."""
    df = chats.withColumn("_turns", turns_of(F.col("formatted"))).withColumn("_loss", learned_text(F.col("formatted"), F.col("loss_spans")))
    joined = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
