"""Gives the package to the Python workers, as --py-files would."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped_to: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Once per application; only the archive is written to the driver's temporary folder."""
    context = spark.sparkContext
    if context.applicationId not in _shipped_to:
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/opinaria", "zip", ROOT, "opinaria")
        context.addPyFile(archive)
        _shipped_to.add(context.applicationId)
