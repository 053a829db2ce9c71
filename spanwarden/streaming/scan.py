"""Scanning files as they arrive (an extension: what is scanned here is each micro-batch by itself).

Detectors need whole texts only, so a batch's findings are final; the score of a whole scan needs an exact
count of files and belongs to a batch over what was written.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanwarden.operators import audit, detect, files


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of files (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)


def scan_batch(batch: DataFrame, out: str, number: int) -> None:
    """Write a batch's merged findings; a repeated batch overwrites what it wrote before."""
    units = files.decoded(batch.select("path", "content")).filter("not skipped").select("path", "text")
    found = audit.merged(audit.with_rules(detect.detect(units, containers=True)))
    found.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:09d}")


def scan(spark: SparkSession, folder: str, out: str, checkpoint: str | None = None) -> StreamingQuery:
    """Scan what lies in the folder and isn't scanned yet, then stop."""
    rows = files.walked(arriving(spark, folder).withColumn("rel_path", F.col("path")))
    query = rows.writeStream.foreachBatch(lambda batch, number: scan_batch(batch, out, number)).trigger(availableNow=True)
    return query.option("checkpointLocation", checkpoint or os.path.join(out, "_checkpoint")).start()
