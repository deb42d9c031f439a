"""Ship this package to the executors, so that functions run by Python workers can import it."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package as a zip archive to the application, once per application."""
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    here = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as d:
        shutil.copytree(here, f"{d}/src/{here.name}", ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='quern-code-')}/{here.name}", "zip", f"{d}/src")
    spark.sparkContext.addPyFile(archive)
    _done.add(app)
