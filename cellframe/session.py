"""Make this package importable in Python workers that do not share the driver's path."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per context, unless PYTHONPATH has it already."""
    context = spark.sparkContext
    if str(_ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_cellframe_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "cellframe.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    context.addPyFile(target)
    context._cellframe_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where it is unset and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there when the application ends is removed."""
    path = f"{shared_folder(spark)}/cellframe/{name}-{uuid.uuid4().hex}"
    file_system, where = hadoop_path(spark, path)
    file_system.deleteOnExit(where)
    return path


def hadoop_path(spark: SparkSession, path: str):
    """The path's file system and the path, as Hadoop has them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


@contextlib.contextmanager
def without_shuffles(spark: SparkSession):
    """Jobs whose shuffle files go when they end, and not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
