"""The package's code for Python workers that don't have it installed."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application. The driver serves the file; no executor opens its path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    path = os.path.join(tempfile.mkdtemp(prefix="ranklake-"), "ranklake_modules.zip")
    Path(path).write_bytes(held.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
