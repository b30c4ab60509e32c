"""Intermediate tables in the folder all executors share.

A table written here cuts the lineage and survives the loss of any executor.  The folder
is the session's ``spark.checkpoint.dir``; only where that is unset *and* the master is
local, so that driver and executor are one process, does a temporary folder take its place,
which goes when the process ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folder: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="seqjoin-"))
        atexit.register(shutil.rmtree, _local_folder[0], True)
    return "file://" + _local_folder[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other table uses."""
    return f"{shared_dir(spark)}/seqjoin/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once to the shared folder and read back; computes it now."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every table this application wrote with :func:`materialize`."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/seqjoin/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
