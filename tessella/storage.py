"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where nothing names one, a session in one process gets a folder of its own, removed at its end; on a cluster, whose
    executors would each see another one, that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = Path(own).as_uri()
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in the shared folder, so that they outlive lost executors.

    Their lineage ends here. Sessions that set ``spark.cleaner.referenceTracking.cleanCheckpoints``, as ``session()`` does,
    remove them when nothing refers to them any more.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one, to be written into, which is removed when the driver ends."""
    folder = f"{shared_folder(spark)}/tessella-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder with all it holds."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
