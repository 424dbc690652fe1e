"""Statements that enter the log once: batches that appear whole, and rows of which no user has two with one hash.

A batch writes its tables under a name of its own; nobody reads them until a marker is there, a small file with
the next number, which only one writer can make. A batch is checked against all batches up to a number and
then asks for the next one. If another batch came between, it is checked again against that one too. So every
batch has been checked against all before it, whoever wrote them, and a writer that dies leaves nothing that
is read. A batch whose name is in the log isn't written again.

Events lie in buckets by user, and a check reads those of the batch's users, two columns of them. Statements whose
rows are known are refused whole (strict), or bring only their new rows. A hash that several statements of a
batch hold belongs to the first of them by id, which may be refused for another. Rows without a user or
a hash are an error.

After that the resolver runs over what the new rows touch, and its decisions are part of the same batch.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallowmere.operators.resolve import resolve, undecided
from tallowmere.sources import folders
from tallowmere.sources.log import numbered

BUCKETS, TRIES = 64, 20
TABLES = ["statements", "artifacts", "events", "decisions"]
PAIR = "user_id bigint, debit_seq bigint, credit_seq bigint, matched_by string, confidence int"


def _bucket() -> F.Column:
    return F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).cast("int")


def markers(spark: SparkSession, path: str) -> list[dict]:
    """What is in the log, batch by batch: version, batch, folder, last_seq. A marker that its writer didn't finish marks nothing."""
    out = []
    for name in folders.names(spark, f"{path}/markers"):
        try:
            out.append(json.loads(folders.read_text(spark, f"{path}/markers/{name}")) | {"version": int(name)})
        except ValueError:
            out.append({"version": int(name), "batch": None, "folder": None, "last_seq": -1})
    return out


def committed(spark: SparkSession, path: str, table: str, schema: str, upto: int | None = None) -> DataFrame:
    """A table's rows in the batches of the log, with `bucket` for those that have it; empty before the first."""
    there = [f"{path}/{table}/{m['folder']}" for m in markers(spark, path) if m["folder"] and (upto is None or m["version"] <= upto)]
    return spark.read.schema(schema).option("basePath", f"{path}/{table}").parquet(*there).drop("batch") if there else spark.createDataFrame([], schema)


def checked(statements: DataFrame, rows: DataFrame, known: DataFrame, strict: bool) -> tuple[DataFrame, DataFrame]:
    """Statements with status, records_added and records_skipped, and the rows that come in if their statement does.

    `rows` (ingestion_event_id, user_id, idempotency_hash, ...), `known` (user_id, idempotency_hash) of the log. Rows meet
    the log and each other by user and hash in one shuffle, and what became of them is written once.
    """
    key = ["user_id", "idempotency_hash"]
    order = [c for c in ("ingestion_event_id", "source_seq") if c in rows.columns]
    same = W.partitionBy(*key)
    old = known.select(*key).distinct().withColumn("old", F.lit(True))
    marked = rows.join(old, key, "left").withColumns({"owner": F.min("ingestion_event_id").over(same), "place": F.row_number().over(same.orderBy(*order))})
    marked = marked.withColumn("fresh", F.col("old").isNull() & (F.col("owner") == F.col("ingestion_event_id"))).drop("owner", "old")
    marked = folders.kept(marked, "marked")
    counts = marked.groupBy("ingestion_event_id").agg(F.count_if("fresh").alias("fresh_rows"), F.count_if(~F.col("fresh")).alias("known_rows"))
    out = statements.join(counts, "ingestion_event_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("fresh_rows", "known_rows")})
    fine = F.coalesce(F.col("balance_check").isin("pass", "not_applicable"), F.lit(False))
    clash = (F.col("known_rows") > 0) & F.lit(strict)
    status = F.when(~fine, "rejected").when(clash, "duplicate").otherwise("ingested")
    out = out.withColumn("status", status).withColumns({"records_added": F.when(F.col("status") == "ingested", F.col("fresh_rows")).otherwise(0), "records_skipped": F.col("known_rows")}).drop("fresh_rows", "known_rows")
    return out, marked.where("fresh AND place = 1").drop("fresh", "place")


def commit(statements: DataFrame, rows: DataFrame, path: str, batch: str, strict: bool = True) -> int:
    """Brings a batch into the log and gives its version.

    `statements`: ingestion_event_id, user_id, balance_check, content_hash and others; `rows`: ingestion_event_id, user_id,
    account_type, value_date, amount_paise, idempotency_hash and others, numbered anew as `seq` in the order of
    statement, `source_seq` and hash. Stands a repeated call, a dead writer and writers at the same time.
    """
    spark = statements.sparkSession
    events = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, seq bigint, bucket int"
    buckets = None
    for _ in range(TRIES):
        log = markers(spark, path)
        for m in log:
            if m["batch"] == batch:
                return m["version"]
        if buckets is None:  # a batch that is in the log isn't read
            if not rows.where("user_id IS NULL OR idempotency_hash IS NULL").isEmpty():
                raise ValueError("a row has no user or hash")
            buckets = [r[0] for r in rows.select(_bucket().alias("b")).distinct().collect()]  # BUCKETS rows at most
        version = max((m["version"] for m in log), default=0)
        last = max((m["last_seq"] for m in log), default=-1)
        folder = f"batch={batch}-{uuid.uuid4().hex}"
        before = committed(spark, path, "events", events, version)
        known = before.where(F.col("bucket").isin(buckets)).select("user_id", "idempotency_hash")
        heads, new = checked(statements, rows, known, strict)
        heads.write.parquet(f"{path}/statements/{folder}")
        heads = spark.read.schema(heads.schema).parquet(f"{path}/statements/{folder}")
        new = new.join(heads.where("status = 'ingested'").select("ingestion_event_id"), "ingestion_event_id", "left_semi")
        order = [c for c in ("ingestion_event_id", "source_seq", "idempotency_hash") if c in new.columns]
        numbered(new, last, order).withColumn("bucket", _bucket()).write.partitionBy("bucket").parquet(f"{path}/events/{folder}")
        written = spark.read.schema(events).parquet(f"{path}/events/{folder}")
        heads.select("ingestion_event_id", "user_id", "content_hash", (F.col("status") != "ingested").alias("retained")).write.parquet(f"{path}/artifacts/{folder}")
        touched = written.select("user_id", F.abs("amount_paise").alias("size")).distinct()
        near = before.where(F.col("bucket").isin(buckets)).withColumn("size", F.abs("amount_paise")).join(touched, ["user_id", "size"], "left_semi").drop("size")
        decided = committed(spark, path, "decisions", PAIR, version)
        resolve(undecided(near.unionByName(written), decided)).write.parquet(f"{path}/decisions/{folder}")
        top = written.agg(F.max("seq")).first()[0]
        if folders.put_if_absent(spark, f"{path}/markers/{version + 1:020d}", json.dumps({"batch": batch, "folder": folder, "last_seq": last if top is None else top})):
            return version + 1
    raise RuntimeError(f"other batches came first {TRIES} times")
