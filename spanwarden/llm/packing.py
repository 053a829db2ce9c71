"""Packing by optimal length buckets.

Texts are cut into pieces of at most ``LONGEST`` tokens. A global histogram of piece lengths, rounded
up to multiples of ``GRAIN`` (1: as they are), feeds a dynamic programme that chooses ``BUCKETS`` bucket boundaries with
the least padding. Inside each bucket the pieces, in order of shard and key, form batches of as many
rows as fit the token budget at the bucket's length.

Pieces alike in id, number and length are counted first (they are interchangeable), so an id that
many rows share, or lack, is one row for each length. Those are numbered within (bucket, shard) and
offset by the shards before; no bucket meets in one task. Tokens are white-space words unless another
``tokens`` expression is given.

Defined results: null and wordless texts give no piece; repeated rows are packed each; ids are of any
type; rows without doc_id are packed under a null id; pieces of one place in the order go to
neighbouring slots in any order; an empty table gives none; a text of any length gives as many pieces as it
takes; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanwarden.llm.common import WORD_PATTERN, cut, quoted

LONGEST, GRAIN, BUCKETS, BUDGET = 2048, 1, 8, 16_384
SHARDS = 256
#: More shards than SHARDS where they would hold more rows than this.
SHARD_ROWS = 1 << 20
#: Copies of a piece that are laid out from one row.
COPIES = 1 << 16


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST, tokens: Callable[[Column], Column] = token_count) -> DataFrame:
    """(doc_id, piece, n_tokens): one row for each stretch of at most ``longest`` tokens."""
    n = docs.select(F.col(quoted(doc_id)).alias("doc_id"), tokens(F.col(quoted(text))).cast("long").alias("n")).filter("n > 0")
    whole = n.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {longest}"))))
    return whole.select("doc_id", "piece", F.least(F.lit(longest).cast("long"), F.col("n") - F.col("piece") * longest).alias("n_tokens"))


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The bucket boundaries (the last is the longest) that pad least.

    ``lengths`` ascend; a row of length l in a bucket of boundary b pads b - l. Ties choose the
    smaller boundary before.
    """
    if not lengths:
        return []
    x, c = np.array(lengths, np.int64), np.array(counts, np.int64)
    n = len(x)
    rows, tokens = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    # pad[i, j]: all of lengths i .. j - 1 under boundary x[j - 1]
    i, j = np.arange(n + 1)[:, None], np.arange(1, n + 1)[None, :]
    pad = np.where(i < j, (rows[j] - rows[i]) * x[j - 1] - (tokens[j] - tokens[i]), np.iinfo(np.int64).max // 4)
    best = np.full(n + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    came: list[np.ndarray] = []
    for _ in range(min(buckets, n)):
        through = best[:, None] + pad
        came.append(through.argmin(axis=0))
        best = np.concatenate([[np.iinfo(np.int64).max // 4], through.min(axis=0)])
    out, at = [], n
    for back in reversed(came):
        out.append(int(x[at - 1]))
        at = int(back[at - 1])
    return out[::-1]


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST, grain: int = GRAIN, buckets: int = BUCKETS, budget: int = BUDGET, tokens: Callable[[Column], Column] = token_count) -> DataFrame:
    """(doc_id, piece, n_tokens, bucket, batch, slot) of every piece; bucket is the padded length."""
    rows = cut(pieces(docs, doc_id, text, longest, tokens).groupBy("doc_id", "piece", "n_tokens").agg(F.count("*").alias("same")))
    cell = F.least(F.ceil(F.col("n_tokens") / grain).cast("long") * grain, F.lit(longest).cast("long"))
    # at most longest / grain rows
    histogram = sorted((r["cell"], r["n"]) for r in rows.groupBy(cell.alias("cell")).agg(F.sum("same").alias("n")).collect())
    ends = boundaries([h[0] for h in histogram], [h[1] for h in histogram], buckets)
    bucket = F.lit(None).cast("long")
    for end in reversed(ends):
        bucket = F.when(F.col("n_tokens") <= end, F.lit(end).cast("long")).otherwise(bucket)
    shards = max(SHARDS, sum(h[1] for h in histogram) // SHARD_ROWS)
    name = F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("piece").cast("string"), F.col("n_tokens").cast("string"))
    shard = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % shards
    rows = rows.withColumn("bucket", bucket).withColumn("shard", shard.cast("long"))
    # buckets x shards rows
    sums = rows.groupBy("bucket", "shard").agg(F.sum("same").alias("n"))
    before = cut(sums.select(F.col("bucket").alias("b"), F.col("shard").alias("s"), (F.sum("n").over(W.partitionBy("bucket").orderBy("shard")) - F.col("n")).alias("before")))
    ordered = W.partitionBy("bucket", "shard").orderBy("doc_id", "piece", "n_tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = rows.withColumn("r", F.sum("same").over(ordered) - F.col("same"))
    numbered = numbered.join(F.broadcast(before), (F.col("bucket") == F.col("b")) & (F.col("shard") == F.col("s")))
    # copies in runs of COPIES, so that no array holds them all
    numbered = numbered.withColumn("run", F.explode(F.expr(f"sequence(0L, (same - 1) div {COPIES})")))
    numbered = numbered.withColumn("copy", F.explode(F.expr(f"sequence(run * {COPIES}, least(same, (run + 1) * {COPIES}) - 1)")))
    place = F.col("before") + F.col("r") + F.col("copy")
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket"))).cast("long")
    return numbered.select("doc_id", "piece", "n_tokens", "bucket", F.floor(place / fit).cast("long").alias("batch"), (place % fit).cast("long").alias("slot"))
