"""Makes the package importable in Python workers that don't find it on their path."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once an application, unless PYTHONPATH already names its folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped or str(ROOT) in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
        return
    folder = tempfile.mkdtemp()
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/lodestone", "zip", ROOT, "lodestone"))
    _shipped.add(app)
