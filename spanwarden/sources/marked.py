"""Views of the driver tables that carry marks: the natural texts hold almost none.

The expressions are SQL that Spark and DuckDB both read; marks are literal characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FAMILY = "\U0001f468\u200d\U0001f469"
#: residue of doc_id % 16: (where the mark goes, mark)
MARKS = {
    0: ("in", "\u200b"), 1: ("in", "\u00a0"), 2: ("before", "\ufeff"), 3: ("before", f"{_FAMILY} a\u200db "), 4: ("in", "\u202e"), 5: ("before", "\u05d0\u05d1\u202e"),
    6: ("before", "// Co-authored-by: Cursor <c@x.io>\n"), 7: ("after", "\n# Generated with Claude"), 8: ("before", "<!-- Copilot draft -->\n"), 9: ("before", "x = 1  # Sure, heres a helper\n"),
    10: ("before", "# Code generated by protoc\n# Generated by Copilot\n"), 11: ("before", "refined with Gemini\n" * 4), 12: ("before", "---\ntitle: t\ngenerator: Claude\n  child: x\nauthor: me\n---\n"),
    13: ("in", "".join(chr(0xFE00 + i % 16) for i in range(20))), 14: ("in", "sc\u0430n"),
}
PAGE_MARKS = {
    0: '<meta name="generator" content="Claude"></head>', 1: '<META NAME="generator" CONTENT="WordPress 6"></head>', 2: '<script type="application/ld+json">{"x":"trainedAlgorithmicMedia"}</script></head>',
    3: '<link rel="c2pa-manifest" href="m.c2pa"></head>', 4: '</head><body data-ai-generated="true">',
}
EXTENSIONS = (".md", ".txt", ".go", ".html", ".yaml", ".json", ".py", ".png", ".docx")

_cases = {"in": "concat(substr(text, 1, 5), '{}', substr(text, 6))", "before": "concat('{}', text)", "after": "concat(text, '{}')"}
DOCUMENT_SQL = "case doc_id % 16 " + " ".join(f"when {k} then {_cases[where].format(mark)}" for k, (where, mark) in MARKS.items()) + " else text end"
PAGE_SQL = "case page_id % 6 " + " ".join(f"when {k} then replace(html, '</head>', '{mark}')" for k, mark in PAGE_MARKS.items()) + " else html end"
PATH_SQL = f"concat('docs/', cast(doc_id as string), case doc_id % {len(EXTENSIONS)} " + " ".join(f"when {i} then '{e}'" for i, e in enumerate(EXTENSIONS)) + " end)"


def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, text)."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(PATH_SQL).alias("path"), F.expr(DOCUMENT_SQL).alias("text"))


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, path, text)."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.expr("concat('pages/', cast(page_id as string), '.html')").alias("path"), F.expr(PAGE_SQL).alias("text"))
