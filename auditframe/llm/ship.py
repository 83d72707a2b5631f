"""Give Python workers this package where it is not installed on them."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import auditframe

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the workers once per application, by Spark's own file server."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(auditframe.__file__).parent
    path = Path(tempfile.mkdtemp(prefix="auditframe-")) / "auditframe.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
