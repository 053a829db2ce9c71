"""Files of folders as units (path, rel_path, length, content).

Spark's own reader lists and reads in parallel but leaves out names that begin with a dot or an
underscore; ``hidden`` lists folders on the driver instead (paths only) and reads on the executors.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwarden.operators import files

SCHEMA = "path string, rel_path string, length long, content binary"
#: Paths that one task reads.
PER_TASK = 200


def _listed(root: str, skipped: Sequence[str]) -> Iterator[tuple[str, str, int]]:
    """(path, path within the root, length) in order of names; a root may be a file; one that isn't there is an error."""
    if not os.path.isdir(root):
        yield root, os.path.basename(root), os.stat(root).st_size
        return
    for folder, names, own in os.walk(root):
        names[:] = sorted(n for n in names if n not in skipped)
        for name in sorted(own):
            path = os.path.join(folder, name)
            if os.path.isfile(path):
                yield path, os.path.relpath(path, root).replace(os.sep, "/"), os.path.getsize(path)


def _read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in it:
        for at in range(0, len(part), 16):
            some = part.iloc[at : at + 16]
            data = []
            for path in some["path"]:
                with open(path, "rb") as f:
                    data.append(f.read())
            yield some.assign(content=data)


def walked(spark: SparkSession, roots: Sequence[str] = (".",), include: Sequence[str] = (), exclude: Sequence[str] = (), max_bytes: int = files.MAX_BYTES, hidden: bool = False) -> DataFrame:
    """The files that a walk of the roots reads, with their bytes."""
    out = None
    for root in roots or (".",):
        if hidden:
            rows = list(_listed(root, files.SKIPPED_DIRS))
            df = spark.createDataFrame(rows, "path string, rel_path string, length long").repartition(max(1, len(rows) // PER_TASK))
            df = files.walked(df, tuple(include), tuple(exclude), max_bytes).mapInPandas(_read, SCHEMA)
        else:
            base = root if "://" in root else "file://" + os.path.abspath(root)
            df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
            # one slash or three after the scheme
            plain = lambda c: F.regexp_replace(c, r"^file:/+", "/")
            inner = F.regexp_replace(F.substr(plain(F.col("path")), F.length(plain(F.lit(base.rstrip("/")))) + 1), "^/", "")
            name = F.regexp_extract("path", r"([^/]*)\z", 1)
            df = df.withColumn("rel_path", F.when(inner == "", name).otherwise(inner))
            df = files.walked(df, tuple(include), tuple(exclude), max_bytes).select(plain(F.col("path")).alias("path"), "rel_path", "length", "content")
        out = df if out is None else out.unionByName(df)
    return out
