"""Folders for a query's own intermediate files, in the shared folder that the cluster names, one folder for each application."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _own(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemark-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/tidemark/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all intermediate files of this application; no DataFrame that was returned can be read afterwards."""
    target = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once and read back: what several branches of a plan use is computed once, and a lost executor costs only
    tasks that read the table again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
