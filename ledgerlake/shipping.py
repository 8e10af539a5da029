"""Send this package to the executors' Python workers, as ``--py-files`` would."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Once per application; Spark's own file server hands the archive to every executor."""
    context = spark.sparkContext
    if not getattr(context, "_ledgerlake_shipped", False):
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="ledgerlake-")) / "ledgerlake.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent).as_posix())
        context.addPyFile(str(archive))
        context._ledgerlake_shipped = True
    return spark
