"""Send this package to Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's code to the application, once; workers on all executors can then import it."""
    app, top = spark.sparkContext.applicationId, Path(__file__).resolve().parents[1]
    if app not in _shipped:
        _shipped.add(app)
        name = f"{tempfile.mkdtemp(prefix='spark-code-', dir='/tmp')}/{top.name}.zip"
        with zipfile.ZipFile(name, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        spark.sparkContext.addPyFile(name)
