"""A bounded sample of labelled documents, for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwarden.llm.common import quoted


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1).cast("long"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label) of about ``most`` labelled documents outside the held-out fold.

    Rows are taken by a hash of their id, so the same ones on every run; ids with two labels
    count as the larger. ``most`` bounds what is broadcast and what the fit gets.
    """
    own = labels.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(label)).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    own = own.groupBy("doc_id").agg(F.max("label").alias("label")).filter(remainder(F.col("doc_id"), folds) != held_out)
    n = own.count()
    if n > most:
        own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    own = own.withColumnRenamed("doc_id", "_id")
    rows = docs.select(F.col(quoted(doc_id)).alias("_doc"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    return rows.join(F.broadcast(own), F.col("_doc") == F.col("_id")).select("text", "label")
