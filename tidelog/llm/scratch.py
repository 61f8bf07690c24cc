"""Intermediate tables in the folder that the driver and all executors share.

The folder is ``spark.checkpoint.dir`` of the session; only where a session has
none (a local test) is a local folder made and set. Tables stay until
:func:`release` or the end of the session; a lost executor can read them again.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_held: list[str] = []
_results: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/tidelog-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed by :func:`release`."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    hold(path)
    return path


def hold(path: str, result: bool = False) -> None:
    """From now on ``path`` is one that :func:`release` and the session's end remove; a result only that end."""
    if not _held and not _results:
        atexit.register(_at_exit)
    (_results if result else _held).append(path)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Remove one path that nothing reads any more."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if path in _held:
        _held.remove(path)


def release(spark: SparkSession) -> None:
    """Remove all intermediate tables. Frames that still read them can't be used afterwards."""
    for path in list(_held):
        drop(spark, path)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    try:
        _held.extend(_results)
        release(spark)
    except Exception as error:  # the session is closing; what is left lies in the checkpoint folder
        print(f"tidelog: intermediate tables remain: {error}")
