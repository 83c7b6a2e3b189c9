"""The folder that driver and executors share, for files a session writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; one of our own only where it is unset, as in tests."""
    global _own
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, _own, True)
    return "file://" + _own


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing stands at."""
    return f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}/{name}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())
