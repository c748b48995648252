"""Makes this package importable in Python workers that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to all executors, once per application, through Spark's own file server."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.NamedTemporaryFile(prefix="procurelake-", suffix=".zip", delete=False) as out, zipfile.ZipFile(out, "w") as pack:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    pack.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(out.name)
    _SHIPPED.add(app)
