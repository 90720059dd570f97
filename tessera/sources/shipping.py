"""Making the package importable in Python workers of a cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources with the application, once, unless PYTHONPATH has them on every machine."""
    root = Path(__file__).resolve().parents[2]
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or any(os.path.isdir(p) and Path(p).resolve() == root for p in paths):
        return
    target = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((root / "tessera").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
