"""Sends this package to executors that don't have it on their Python path."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: a zip of the package by ``addPyFile``."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        shutil.copytree(package, Path(folder, "src", package.name), ignore=shutil.ignore_patterns("__pycache__"))
        name = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="ship-"), package.name)), "zip", Path(folder, "src"))
    sc.addPyFile(name)
    _shipped.add(sc.applicationId)
