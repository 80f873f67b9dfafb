"""Sessions, and the way this package's code reaches executors."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def session(name: str = "tessella", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC, and checkpoints that are removed when they are no longer used.

    ``conf`` has more settings, dots written as double underscores; on a cluster it, or the cluster's defaults, must name
    the shared folder in ``spark.checkpoint.dir``.
    """
    builder = SparkSession.builder.appName(name).config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of all executors, whatever their working folder is."""
    context = spark.sparkContext
    if getattr(context, "_tessella_shipped", False):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(PACKAGE.rglob("*.py")):
            archive.write(source, source.relative_to(PACKAGE.parent))
    to = Path(tempfile.mkdtemp(prefix="tessella-")) / "tessella_code.zip"
    to.write_bytes(packed.getvalue())
    context.addPyFile(str(to))
    context._tessella_shipped = True
