"""Go sources: identifiers of mixed script, protected literals, stamps that stand in strings.

A lexer is enough for these: it tells strings, runes, comments and identifiers apart by their bytes. A
text that doesn't begin with a package clause, or has an open literal or unbalanced brackets, isn't Go
and gives nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of identifiers and the ASCII ones written for them.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "y", "χ": "x", "γ": "y",
}
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_TOKEN = re.compile(r'(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|`[^`]*`)|(?P<rune>\'(?:\\.[^\'\n]*|[^\'\\\n])\')|(?P<word>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<bad>["`\']|/\*)|(?P<rest>.)', re.S)
_LATIN = re.compile(r"[A-Za-zªºÀ-ÖØ-öø-ʸḀ-ỿＡ-Ｚａ-ｚ]")
_OTHER = re.compile(r"[Ͱ-ͳ͵-ͷͺ-ͽͿ΄ΆΈ-ϡϰ-ԯᲀ-ᲊᴦ-ᴫἀ-῾ⷠ-ⷿꙀ-ꚟ]")


def lexed(source: str) -> list[tuple[str, int, int, str]] | None:
    """(kind, start, end, text) of comments, strings and words, in bytes; None if the source isn't Go."""
    out: list[tuple[str, int, int, str]] = []
    at, depth, code = 0, [], []
    for m in _TOKEN.finditer(source):
        size = len(m[0].encode())
        kind = m.lastgroup or ""
        if kind == "bad":
            return None
        if kind == "open":
            depth.append(m[0])
        elif kind == "close" and (not depth or depth.pop() + m[0] not in ("()", "[]", "{}")):
            return None
        if kind in ("comment", "string", "word"):
            out.append((kind, at, at + size, m[0]))
        if kind in ("word", "number", "string", "rune") and len(code) < 2:
            code.append(m[0])
        at += size
    return out if len(code) == 2 and code[0] == "package" and not depth else None


def mixed(name: str) -> bool:
    return bool(_LATIN.search(name) and _OTHER.search(name))


def ascii_name(name: str) -> str:
    """A name's ASCII letters, digits and look-alikes' letters; never empty, never beginning with a digit."""
    out = "".join(c if c.isascii() and (c.isalnum() or c == "_") else LOOKALIKES.get(c, "") for c in name) or "ident"
    return out if out[0].isalpha() or out[0] == "_" else "x" + out


def replacements(words: list[str]) -> dict[str, str]:
    """An unused ASCII name for each mixed one, the same wherever it stands."""
    taken, out = set(words), {}
    for word in words:
        if mixed(word) and word not in out:
            taken.discard(word)
            base, n = ascii_name(word), 2
            name = base
            while name in taken:
                name, n = f"{base}{n}", n + 1
            taken.add(name)
            out[word] = name
    return out


def _rows(units: DataFrame, schema: str, of) -> DataFrame:
    """What ``of`` makes of the tokens of each Go unit (path, text)."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            rows = [(path, *r) for path, text in zip(part["path"], part["text"], strict=True) if (found := lexed(text)) is not None for r in of(found)]
            yield pd.DataFrame(rows, columns=names)

    # most texts are refuted before they reach Python
    sources = units.filter(F.lower("path").endswith(".go") & F.col("text").rlike(r"(?m)^[ \t]*(/\*.*\*/[ \t]*)?package[ \t\n]"))
    return sources.select("path", "text").mapInPandas(run, schema)


def identifier_marks(units: DataFrame) -> DataFrame:
    """Findings of identifiers that mix scripts, with names to replace them."""

    def of(found):
        words = [w for k, _, _, w in found if k == "word" and w not in KEYWORDS]
        names = replacements(words)
        return [(s, e, w, names[w]) for k, s, e, w in found if k == "word" and w in names]

    df = _rows(units, "path string, start long, end long, evidence string, replacement string", of)
    text = units.select("path", "text")
    df = df.join(text, "path")
    before = F.substr(F.col("text").cast("binary"), F.lit(1), F.col("start").cast("int")).cast("string")
    line, col = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1, F.length(F.substring_index(before, "\n", -1)) + 1
    return df.select("path", F.lit("homoglyph.ident").alias("rule_id"), "start", "end", line.cast("int").alias("line"), col.cast("int").alias("col"), "evidence", "replacement", F.lit("normalize").alias("clean"))


def strings(units: DataFrame) -> DataFrame:
    """(path, p_start, p_end): string literals."""
    return _rows(units, "path string, p_start long, p_end long", lambda found: [(s, e) for k, s, e, _ in found if k == "string"])


def protected(units: DataFrame) -> DataFrame:
    """(path, p_start, p_end, reason, p_order): string literals, then go:generate comments."""

    def of(found):
        spans = [(s, e, "string_literal") for k, s, e, _ in found if k == "string"]
        spans += [(s, e, "go_generate") for k, s, e, t in found if k == "comment" and t.startswith("//go:generate")]
        return [(*x, i) for i, x in enumerate(spans)]

    return _rows(units, "path string, p_start long, p_end long, reason string, p_order long", of)


def comment_fragments(units: DataFrame, least: int = 80) -> DataFrame:
    """(path, body): comments of at least ``least`` bytes without their markers."""

    def of(found):
        bare = (t.removeprefix("//").removeprefix("/*").strip().removesuffix("*/").strip() for k, _, _, t in found if k == "comment")
        return [(b,) for b in bare if len(b.encode()) >= least]

    return _rows(units, "path string, body string", of)


def outside_strings(findings: DataFrame, units: DataFrame) -> DataFrame:
    """Findings but for stamps that overlap a string literal."""
    inside = strings(units).withColumnRenamed("path", "s_path")
    over = (F.col("path") == F.col("s_path")) & F.col("rule_id").startswith("stamp.") & (F.col("start") < F.col("p_end")) & (F.col("p_start") < F.col("end"))
    return findings.join(inside, over, "left_anti")
