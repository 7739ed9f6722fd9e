"""Sends this package to the Python workers, which need not share the driver's module path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT = "_ledgerloom_sent"


def ship(spark: SparkSession) -> None:
    """Once per application: the package's modules as an archive that Spark serves to all executors."""
    context = spark.sparkContext
    if getattr(context, _SENT, False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for module in sorted(package.rglob("*.py")):
            z.write(module, module.relative_to(package.parent))
    context.addPyFile(str(archive))
    setattr(context, _SENT, True)
