"""Sends the package to executors whose search path does not have it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shipped(spark: SparkSession) -> None:
    root = Path(__file__).resolve().parents[1]
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_mailloom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="mailloom-")) / "mailloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in (root / "mailloom").rglob("*.py"):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(archive))
    sc._mailloom_shipped = True
