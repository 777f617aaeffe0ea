"""Tables that a job keeps between its steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session that names none gets a temporary folder, removed at exit."""
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    named = sc.getConf().get("spark.checkpoint.dir", "")
    if not named and sc.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="helixmill-")
        atexit.register(shutil.rmtree, named, True)
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def fresh(spark: SparkSession, name: str) -> str:
    """A path of its own in that folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and read back from a table, for what several branches of a plan use."""
    path = fresh(df.sparkSession, "kept")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes kept tables after their last use; what is not one itself is left alone."""
    for table in tables:
        path = getattr(table, "_kept_at", None)
        if path:
            drop(table.sparkSession, path)


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def drop(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
