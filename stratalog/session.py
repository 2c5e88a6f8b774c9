"""Session helpers shared by every entry point."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's sources to the executors' Python workers, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_stratalog_shipped", False):
        return spark
    target = Path(tempfile.mkdtemp(prefix="stratalog-src-")) / "stratalog_src.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(_PACKAGE.rglob("*.py")):
            archive.write(source, str(source.relative_to(_PACKAGE.parent)))
    context.addPyFile(str(target))
    context._stratalog_shipped = True
    return spark
