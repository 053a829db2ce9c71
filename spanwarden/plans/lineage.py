"""Cuts a plan by writing what it gives to the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, materialised under ``spark.checkpoint.dir`` (in local mode, where it is unset, a temporary folder)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[[^,]*(,[0-9]+)?\])?$", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = "file://" + os.path.join(tempfile.gettempdir(), f"spanwarden-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
