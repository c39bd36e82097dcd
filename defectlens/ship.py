"""Sending the package to the executors' Python workers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add this package to the job once per application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory(prefix="package-") as folder:
        root = Path(folder) / "root"
        shutil.copytree(package, root / package.name, ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="package-")) / package.name), "zip", root)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
