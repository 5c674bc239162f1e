"""The package's own code for executors, which need not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import tessella

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to all executors, once in an application; Spark hands the archive on."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = os.path.dirname(os.path.abspath(tessella.__file__))
    path = os.path.join(tempfile.mkdtemp(), "tessella.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(root)))
    context.addPyFile(path)
