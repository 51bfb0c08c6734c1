"""Makes this package importable on executors that do not have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to the executors, once for each application, unless PYTHONPATH holds them already."""
    app = spark.sparkContext.applicationId
    root = Path(__file__).resolve().parent
    known = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _SHIPPED or str(root.parent) in known:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="quarry-"), "quarry.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
