"""This package on the executors: sent along once per context, so that tasks import it wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession | None = None) -> None:
    """Send the package's modules to the executors of spark (the active session by default); later calls do nothing."""
    spark = spark or SparkSession.active()
    sc = spark.sparkContext
    if getattr(sc, "_plumbline_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="plumbline-"), "plumbline_code.zip")  # the driver serves it from there
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._plumbline_shipped = True
