"""Stored tables of an archive: chunks, postings, vectors by cell, edges, metadata.

A store is a folder of Parquet tables that is written once and read by every batch of questions, so that a question's
plan neither tokenises the archive nor builds its graphs.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_made: dict[tuple[str, str], str] = {}
_temporary: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; unset, a temporary one on a local master, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: stored tables need a folder that all executors share")
        known = spark.sparkContext.applicationId
        if known not in _temporary:
            _temporary[known] = tempfile.mkdtemp(prefix="lodestrata-")
            atexit.register(shutil.rmtree, _temporary[known], ignore_errors=True)
        path = _temporary[known]
    return path.rstrip("/")


def kept(rows: DataFrame, name: str) -> DataFrame:
    """rows, written to the shared folder and read again: cuts the lineage, and a lost executor costs only its running tasks."""
    path = f"{shared_folder(rows.sparkSession)}/lodestrata/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def stored_folder(df: DataFrame, name: str, of: str, build: Callable[[DataFrame, str], None]) -> str:
    """The folder of a store made of df, written when it is first asked for in a session (name it by what it is made `of`)."""
    spark = df.sparkSession
    known = (spark.sparkContext.applicationId, f"{name}|{of}")
    if known not in _made:
        path = f"{shared_folder(spark)}/lodestrata/store-{name}-{uuid.uuid4().hex}"
        build(df, path)
        _made[known] = path
    return _made[known]


def stored(df: DataFrame, name: str, of: str, build: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
    """df's table, written when it is first asked for in a session, then read."""
    return df.sparkSession.read.parquet(stored_folder(df, name, of, build or (lambda df, path: df.write.parquet(path))))


def forget_stored() -> None:
    """The next time each store is asked for, it is made anew: call it where the data of a folder have changed."""
    _made.clear()
