"""The folder that driver and executors share, for tables and streams of a query."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, in which ``checkpoint()`` writes too.

    Where a local session names no such folder (as in tests) a temporary one is set; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] not in ("local", "local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when Python ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def _drop() -> None:
    for spark, path in _made:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may have ended; the folder is then left to its owner
            return


atexit.register(_drop)
