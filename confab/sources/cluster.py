"""Makes this package importable in the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once a session, unless PYTHONPATH or the working folder has it."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.getcwd()]
    if app in _SHIPPED or any(Path(p).resolve() == root for p in paths):
        return
    _SHIPPED.add(app)
    path = os.path.join(tempfile.mkdtemp(prefix="confab-"), "confab.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "confab").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(path)
