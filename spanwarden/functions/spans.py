"""Byte spans of pattern hits, from the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hits(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """One row per hit of a Java pattern: hit, start and end (bytes), at (code points before it), line, col.

    The running sums are kept in one fold over the hits, so a text is split once.
    """
    gaps, found = F.split(F.col(text), pattern, -1), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    zero = F.expr("named_struct('byte', 0, 'at', 0, 'line', 1, 'tail', '', 'out', cast(array() as array<struct<hit:string,start:int,end:int,at:int,line:int,col:int>>))")

    def lines(x: Column) -> Column:
        return F.length(x) - F.length(F.replace(x, F.lit("\n")))

    def tail(old: Column, new: Column) -> Column:
        return F.when(F.contains(new, F.lit("\n")), F.substring_index(new, "\n", -1)).otherwise(F.concat(old, new))

    def step(acc: Column, x: Column) -> Column:
        before = tail(acc["tail"], x["gap"])
        start, at, line = acc["byte"] + F.octet_length(x["gap"]), acc["at"] + F.length(x["gap"]), acc["line"] + lines(x["gap"])
        end = start + F.octet_length(x["hit"])
        row = F.struct(x["hit"].alias("hit"), start.alias("start"), end.alias("end"), at.alias("at"), line.alias("line"), (F.length(before) + 1).alias("col"))
        return F.struct(end.alias("byte"), (at + F.length(x["hit"])).alias("at"), (line + lines(x["hit"])).alias("line"), tail(before, x["hit"]).alias("tail"), F.array_append(acc["out"], row).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return df.filter(F.col(text).rlike(pattern)).select("*", F.inline(F.aggregate(pairs, zero, step)["out"]))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row: the optimiser doesn't inline through a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
