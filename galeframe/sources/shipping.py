"""Gives the executors this package, wherever the driver was started."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    with tempfile.TemporaryDirectory() as folder:
        copy = Path(folder, "ship", package.name)
        shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(str(Path(tempfile.mkdtemp(), package.name)), "zip", copy.parent))
    _shipped.add(context.applicationId)
