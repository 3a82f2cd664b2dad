"""Where operators write what they read again: the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is set: a temporary folder for a local master; on a cluster that is an error."""
    found, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not found and sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc._jsc.sc().getCheckpointDir().get()
    if not found and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        found = "file://" + tempfile.mkdtemp(prefix="sheaf-")
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/sheaf-{name}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path as its own)."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place
