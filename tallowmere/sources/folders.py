"""Folders that driver and executors share, and small files in them, through Spark's own file systems."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared(spark: SparkSession, name: str) -> str:
    """A new folder where the session's checkpoints go, removed when the program ends.

    Where the session names none: a temporary folder if all runs in this one process, else an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tallowmere-")
        _OWN[spark.sparkContext.applicationId] = base
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to a shared folder and read from there, for what is used several times."""
    path = shared(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        fs, at = _at(spark, path)
        fs.delete(at, True)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    fs, at = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at) if not f.getPath().getName().startswith((".", "_"))) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _at(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file, whole or not at all; false if it is there. Rests on the store's refusal to create a file twice."""
    fs, at = _at(spark, path)
    fs.mkdirs(at.getParent())
    try:
        stream = fs.create(at, False)
    except Exception as failed:
        if exists(spark, path):
            return False
        raise failed
    stream.write(bytearray(text.encode()))
    stream.close()
    return True
