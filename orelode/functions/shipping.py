"""The package on the executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once for each application, by Spark's own file server."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    kept = Path(tempfile.gettempdir(), f"{top.name}-{uuid.uuid4().hex[:8]}.zip").absolute()
    with zipfile.ZipFile(kept, "w") as out:
        for f in sorted(top.rglob("*.py")):
            out.write(f, Path(top.name, f.relative_to(top)))
    sc.addPyFile(str(kept))
    atexit.register(lambda: kept.unlink(missing_ok=True))
    _shipped.add(sc.applicationId)
