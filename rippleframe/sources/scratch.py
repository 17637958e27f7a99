"""The folder for tables between steps, which all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a local session gets a temporary one; on a cluster it
    is an error, as machines don't share theirs."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="rippleframe-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/rippleframe-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder of tables that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
