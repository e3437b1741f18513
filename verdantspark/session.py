"""Sessions: how executors get this package."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once an application; it need not be installed there."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        here = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp()) / f"{here.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        sc.addPyFile(str(archive))
        _shipped.add(sc.applicationId)
    return spark
