"""Snapshots of projections, named by manifests: readers take the newest good one and rebuild where there is none.

A snapshot is written under a name of its own; then its manifest, a small file with the next number, names it, the last
event in it and its number of rows. A snapshot whose manifest is missing, doesn't read, or disagrees with what lies
in its folder isn't used. Reading looks at manifests from the newest on and at one snapshot's rows.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallowmere.sources import folders
from tallowmere.sources.folds import fold


def save(states: DataFrame, path: str, name: str, last_seq: int) -> str:
    """Stores `states`, which hold all events up to `last_seq`, and gives the folder's name."""
    spark, folder = states.sparkSession, f"upto-{last_seq}-{uuid.uuid4().hex}"
    states.write.parquet(f"{path}/{name}/rows/{folder}")
    found = json.dumps({"folder": folder, "last_seq": last_seq, "rows": spark.read.parquet(f"{path}/{name}/rows/{folder}").count(), "schema": states.schema.json()})
    number = max((int(n) for n in folders.names(spark, f"{path}/{name}/manifests")), default=0) + 1
    while not folders.put_if_absent(spark, f"{path}/{name}/manifests/{number:020d}", found):
        number += 1
    return folder


def newest(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, int] | None:
    """The newest good snapshot's rows and its last event; None if there is none."""
    found = []
    for number in folders.names(spark, f"{path}/{name}/manifests"):
        try:
            m = json.loads(folders.read_text(spark, f"{path}/{name}/manifests/{number}"))
            found.append((m["last_seq"], int(number), m["folder"], m["rows"]))
        except (ValueError, KeyError, TypeError):
            continue
    for last_seq, _, folder, rows in sorted(found, reverse=True):
        at = f"{path}/{name}/rows/{folder}"
        if folders.exists(spark, f"{at}/_SUCCESS"):
            try:
                df = spark.read.parquet(at)
                if df.count() == rows:
                    return df, last_seq
            except (PySparkException, Py4JJavaError):  # a file that is gone, or is no table
                continue
    return None


def current(events: DataFrame, path: str, name: str, projection: str) -> DataFrame:
    """A projection of all events: from the newest good snapshot and what came after it, else from the first event on."""
    found = newest(events.sparkSession, path, name)
    if found is None:
        return fold(events, projection)
    states, last_seq = found
    return fold(events.where(F.col("seq") > last_seq), projection, states)
