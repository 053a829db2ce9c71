"""Lets Python workers import this package wherever the session runs."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for folder, _, names in os.walk(_PACKAGE):
                for name in sorted(n for n in names if n.endswith(".py")):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(_PACKAGE)))
        # the driver's file server reads the file whenever an executor starts, so it stays
        folder = tempfile.mkdtemp(prefix="spanwarden-")
        path = os.path.join(folder, f"{os.path.basename(_PACKAGE)}.zip")
        with open(path, "wb") as f:
            f.write(data.getvalue())
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.addPyFile(path)
        _sent.add(app)
    return spark

