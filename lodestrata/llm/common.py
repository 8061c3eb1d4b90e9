"""Shared helpers: table access and staging through the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_temporary: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Unset, it is a temporary one on a local master, and an error on a cluster,
    whose executors would each write to a disk of their own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is not set: staged tables need a folder that all executors of {master} share")
        known = spark.sparkContext.applicationId
        if known not in _temporary:
            _temporary[known] = tempfile.mkdtemp(prefix="lodestrata-")
            atexit.register(shutil.rmtree, _temporary[known], ignore_errors=True)
        path = _temporary[known]
    return path.rstrip("/")


def stage_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lodestrata/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    Cuts the lineage: a lost executor costs only the tasks that it was running.
    """
    spark = df.sparkSession
    path = stage_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Delete the session's staged tables, once the results that read them are written. Works on any Hadoop file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lodestrata")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
