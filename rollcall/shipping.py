"""Sends this package's modules to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: Python functions that run in tasks can import the package there."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="rollcall-"), "rollcall.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _sent.add(app)
