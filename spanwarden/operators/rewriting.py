"""What may be rewritten by a model, and what comes back from one; nothing is called from here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwarden.operators import audit, detect

# Marks that make a file worth rewriting, prose suffixes, least lengths in code points.
MARKS = ("stamp", "c2pa", "unicode", "metadata", "heuristic")
PROSE = r"\.(md|txt|html|htm|rst|adoc)\z"
LEAST_PROSE, LEAST_COMMENT = 280, 80
# Names of strengths and of backends.
STRENGTHS = ("paraphrase", "humanize", "code", "backtranslate", "structural")
BACKENDS = {"": "print", "print": "print", "prompt": "print", "print-prompt": "print", "ollama": "ollama", "openai": "openai", "openai-compatible": "openai", "native": "openai"}


def strength(name: str, strict: bool = False) -> str:
    """A strength by name; an unknown one is paraphrase, or an error where ``strict``."""
    low = name.strip().lower()
    if low in STRENGTHS:
        return low
    if strict and low:
        raise ValueError(f"unknown strength: {name}")
    return STRENGTHS[0]


def backend(name: str) -> str:
    """A backend by any of its names."""
    try:
        return BACKENDS[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown backend: {name}") from None


def planned(units: DataFrame, findings: DataFrame, force: bool = False) -> DataFrame:
    """(path, rule_id, start, end): whole prose texts, else long comments, of marked units (or all, with ``force``)."""
    texts = units.filter(detect.payload(F.col("path"), F.col("text")))
    if not force:
        marked = findings.filter(F.col("family").isin(*MARKS)).select("path").distinct()
        texts = texts.join(marked, "path", "left_semi")
    prose = F.lower("path").rlike(PROSE) & (F.length("text") >= LEAST_PROSE)
    whole = texts.filter(prose).select("path", F.lit("statwm.layer_b_prose").alias("rule_id"), F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end"))
    notes = detect.comments(texts.filter(~prose)).filter(audit.long_comment(F.col("region")))
    start = F.col("offset") + F.col("region_offset")
    return whole.unionByName(notes.select("path", F.lit("statwm.layer_b_comment").alias("rule_id"), start.cast("long").alias("start"), (start + F.octet_length("region")).cast("long").alias("end")))


def comment_texts(units: DataFrame, least: int) -> DataFrame:
    """(path, number, body): comments without their markers, of at least ``least`` bytes."""
    body = F.regexp_replace(F.col("region"), r"^[ \t\r]*(?:<!--|//+|/\*+|--|#+|\*+)[ \t\r]*|[ \t\r]*(?:-->|\*/)?[ \t\r]*\z", "")
    rows = detect.comments(units).select("path", "number", body.alias("body"))
    return rows.filter(F.octet_length("body") >= least)


def answer(reply: Column) -> Column:
    """The text that a model's reply holds: its JSON field ``rewrite``, else the reply without code fences."""
    field = F.get_json_object(F.trim(reply), "$.rewrite")
    bare = F.regexp_replace(F.trim(reply), r"(?s)\A```[^\n]*\n(.*?)\n?```\z", "$1")
    return F.coalesce(F.nullif(field, F.lit("")), F.trim(bare))
