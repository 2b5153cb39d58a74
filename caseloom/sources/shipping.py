"""Making the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers of this application, once; not needed where PYTHONPATH has it."""
    path = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if ROOT in path or app in _shipped:
        return
    name = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-")), "caseloom.zip")
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in os.walk(os.path.join(ROOT, "caseloom")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, ROOT))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)
