"""The package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Send the package to executors that do not find it by PYTHONPATH or in their working folder."""
    context = spark.sparkContext
    found = ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    beside = context.master.startswith("local[") and os.path.samefile(os.getcwd(), ROOT)
    if found or beside or getattr(context, "_quire_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="quire-"), "quire.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, files in os.walk(os.path.join(ROOT, "quire")):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, ROOT))
    context.addPyFile(path)
    context._quire_shipped = True
