"""Tables written to the cluster's shared folder: computed once, lineage cut, safe against lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset and executors share the driver's disk, a temporary folder of this session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = "file://" + tempfile.mkdtemp(prefix="allelia-")
    return _own_root[app]


_left_behind: dict[str, tuple] = {}


def folder(spark: SparkSession) -> str:
    """Where this application's tables are; they are deleted when the driver's process ends."""
    path = f"{shared_root(spark)}/allelia-{spark.sparkContext.applicationId}"
    if path not in _left_behind:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        _left_behind[path] = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where
    return path


@atexit.register
def _clean_up() -> None:
    from py4j.protocol import Py4JError, Py4JNetworkError

    for system, where in _left_behind.values():
        try:
            system.delete(where, True)
        except (Py4JError, Py4JNetworkError, OSError):
            return  # the JVM is gone


def purge(spark: SparkSession) -> None:
    """Delete all tables of this application; results that are not written yet can no longer be read."""
    discard(spark, folder(spark))


_made: dict[str, list[str]] = {}


def made(spark: SparkSession) -> list[str]:
    """The tables that this application has stored so far."""
    return list(_made.get(folder(spark), []))


def stored(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.setdefault(folder(spark), []).append(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    return stored(df, tag)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
