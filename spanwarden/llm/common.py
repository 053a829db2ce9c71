"""Helpers that several corpus operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Whitespace-separated words, as quality rules and near-duplicates count them.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only in local mode, where the session names none (tests, a laptop), a temporary folder is made; on a
    cluster executors wouldn't see each other's files there, so the setting is asked for.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[[^,]*(,[0-9]+)?\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"spanwarden-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once, in the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut``, and the number of rows, counted as they are written: no query of its own for the driver."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    # what is known to be empty isn't observed
    return out, seen.get.get("n", 0)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, or ``name`` with underscores appended until no column of ``taken`` has it."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in df.columns]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def join_small(left: DataFrame, right: DataFrame, keys: Sequence[str], right_rows: int, how: str = "left", limit: int = 100_000, salts: int = 16) -> DataFrame:
    """Join on ``keys`` (null equals null) against a side whose row count is known.

    Up to ``limit`` rows the right side is broadcast; beyond it both sides are dealt by key and
    salt, so that one hot key spreads over ``salts`` partitions.
    """
    marks = {k: fresh(f"_r_{k}", [*left.columns, *right.columns]) for k in keys}
    right = right.select(*[F.col(quoted(k)).alias(marks[k]) for k in keys], *[F.col(quoted(c)) for c in right.columns if c not in keys])
    on = [F.col(quoted(k)).eqNullSafe(F.col(marks[k])) for k in keys]
    if right_rows <= limit:
        out = left.join(F.broadcast(right), on, how)
        return out.drop(*marks.values())
    a, b = fresh("_salt_l", left.columns), fresh("_salt_r", left.columns)
    left = left.withColumn(a, F.pmod(F.xxhash64(*[F.col(quoted(c)) for c in left.columns]), F.lit(salts)))
    right = right.withColumn(b, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [*on, F.col(a) == F.col(b)], how).drop(a, b, *marks.values())


#: Bits that ``sifted`` broadcasts for each key, at least, and altogether, at most (64 MiB).
SIFT_BITS, SIFT_MOST = 32, 1 << 29
#: Bits of a block, in words of 64.
_BLOCK = 4096


def sifted(left: DataFrame, key: str, right: DataFrame, right_rows: int) -> DataFrame:
    """The rows of ``left`` whose ``key`` may be one of ``right``'s: all that are, and few others (one in a thousand at ``SIFT_BITS``).

    No side is dealt out, however many keys there are: a Bloom filter of them is broadcast (Bloom, 1970), in
    blocks, each of which holds all three bits of its keys (Putze, Sanders and Singler, 2007). Beyond
    ``SIFT_MOST`` more others stay. ``right`` is read once, so it should be materialised.
    """
    x, block, words = (fresh(c, left.columns) for c in ("_x", "_block", "_words"))
    bits = min(SIFT_MOST, max(_BLOCK, 1 << (SIFT_BITS * right_rows - 1).bit_length()))
    of = f"{x} & {bits // _BLOCK - 1}L"
    places = [f"cast(shiftrightunsigned({x}, {by}) & {_BLOCK - 1}L as int)" for by in (20, 32, 44)]
    rows = right.select(F.xxhash64(quoted(key)).alias(x)).select(F.expr(of).alias(block), F.explode(F.expr(f"array({', '.join(places)})")).alias(x))
    rows = rows.groupBy(block, F.expr(f"{x} div 64").cast("int").alias("i")).agg(F.expr(f"bit_or(shiftleft(1L, {x} % 64))").alias("bits"))
    rows = rows.groupBy(block).agg(F.map_from_entries(F.collect_list(F.struct("i", "bits"))).alias(words))
    rows = rows.select(block, F.expr(f"transform(sequence(0, {_BLOCK // 64 - 1}), i -> coalesce(element_at({words}, i), 0L))").alias(words))
    may = " and ".join(f"getbit(get({words}, cast({p} div 64 as int)), {p} % 64) = 1" for p in places)
    # a block is one row: no row of the left side meets two
    out = left.withColumn(x, F.xxhash64(quoted(key))).join(F.broadcast(rows), F.expr(f"{block} = ({of}) and {may}"))
    return out.select(*columns(left))


def sliced(offsets, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = i + 1
        while j < n and offsets[j + 1] - offsets[i] <= limit:
            j += 1
        yield i, j
        i = j
