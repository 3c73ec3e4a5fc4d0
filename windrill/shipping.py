"""Gives the executors this package, so that a cluster needs no installation of it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the application, once for each Spark context."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="windrill-")  # on the driver; Spark copies the file to every executor
    path = os.path.join(folder, "windrill_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"windrill/{f.relative_to(root)}")
    context.addPyFile(path)
    _sent.add(context.applicationId)
