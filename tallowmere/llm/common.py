"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longest run of characters that one Python step splits into words at a time.
SLICE_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application where the session's checkpoints go, which driver and executors share.

    Where the session names none: a temporary folder if all runs in this one process, else an error. It is removed
    when the program ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and spark.sparkContext.master.startswith("local"):
        named = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tallowmere-")
        _OWN[spark.sparkContext.applicationId] = named
    if not named:
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    named = f"{named.rstrip('/')}/tallowmere-{spark.sparkContext.applicationId}"
    if named not in _USED:
        _USED.add(named)
        atexit.register(_remove, spark, named)
    return named


_OWN: dict[str, str] = {}
_USED: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return  # nobody is left to remove it by
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back, which cuts its lineage durably."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def discard(*kept: DataFrame) -> None:
    """Remove tables that `keep` wrote and that nothing reads any more."""
    for df in kept:
        _remove(df.sparkSession, df._kept_at)


def bounded(df: DataFrame, rows: int, size: int = 64 << 20) -> DataFrame:
    """`df`, to be broadcast if it has at most `rows` rows of at most `size` bytes; beyond that joins shuffle it."""
    wide = [F.length(F.to_json(F.struct(f.name))) for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
    each = F.lit(8 * len(df.columns)).cast("long")
    for w in wide:
        each += F.coalesce(w, F.lit(0))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(each), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if found.n <= rows and found.bytes <= size else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(texts: list, limit: int = SLICE_CHARS):
    """Runs of `texts` with about `limit` characters each; a longer text is a run of its own."""
    start = size = 0
    for k, t in enumerate(texts):
        if k > start and size + len(t) > limit:
            yield texts[start:k]
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield texts[start:]
