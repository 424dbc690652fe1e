"""Uploads before they are in the log: sessions that run out, previews, and the commit of the confirmed ones.

`sessions` has one row a statement (session_id, user_id, account_ref, account_type, period_start, period_end,
opening_paise, closing_paise, balance_check, confidence, content_hash, created_at), `rows` its transactions
by session_id. Nothing in a staging table is rewritten: sessions end by time or by an entry in `ended`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallowmere.sources import folders

#: Fixed value: seconds that a session lives.
SESSION_SECONDS = 3600
ACCEPTED = ["pass", "not_applicable"]
TABLES = ["statements", "artifacts", "events"]


def with_expiry(sessions: DataFrame, seconds: int = SESSION_SECONDS) -> DataFrame:
    return sessions.withColumn("expires_at", F.col("created_at") + F.make_interval(secs=F.lit(seconds)))


def live(sessions: DataFrame, now: Column, ended: DataFrame | None = None) -> DataFrame:
    """Sessions neither run out by `now` nor ended. `ended`: session_ids, repeated or unknown ones do no harm."""
    out = sessions.where(F.col("expires_at") > now)
    return out if ended is None else out.join(ended.select("session_id"), "session_id", "left_anti")


def preview(sessions: DataFrame, rows: DataFrame) -> DataFrame:
    """What an upload would bring: the header, the check and the rows' number and sum."""
    sums = rows.groupBy("session_id").agg(F.count("*").alias("row_count"), F.sum("amount_paise").alias("net_paise"))
    out = sessions.join(sums, "session_id", "left")
    return out.select("session_id", "user_id", "account_ref", "period_start", "period_end", "opening_paise", "closing_paise", "balance_check", "confidence", F.coalesce("row_count", F.lit(0)).alias("row_count"), F.coalesce("net_paise", F.lit(0)).alias("net_paise"))


def confirm(sessions: DataFrame, rows: DataFrame) -> dict[str, DataFrame]:
    """The three tables that live sessions become: statements, artifacts and events.

    A statement that fails its check is recorded as rejected without events, and its artifact is kept.
    """
    fine = F.coalesce(F.col("balance_check").isin(ACCEPTED), F.lit(False))
    seen = preview(sessions, rows).select("session_id", "row_count")
    checked = sessions.join(seen, "session_id").withColumn("fine", fine)
    statements = checked.select(
        F.col("session_id").alias("ingestion_event_id"), "user_id", "account_ref", "account_type", "period_start", "period_end", "opening_paise", "closing_paise", "balance_check", "confidence",
        F.when(F.col("fine"), "ingested").otherwise("rejected").alias("status"),
        F.when(F.col("fine"), F.col("row_count")).otherwise(0).alias("records_added"),
    )
    artifacts = checked.select(F.col("session_id").alias("ingestion_event_id"), "user_id", "content_hash", (~F.col("fine")).alias("retained"))
    kind = F.when(F.col("amount_paise") < 0, "debit").otherwise("credit")
    events = rows.join(checked.where("fine").select("session_id"), "session_id", "left_semi")
    events = events.withColumns({"transaction_type": kind, "event_type": F.lit("TransactionIngested")}).withColumnRenamed("session_id", "ingestion_event_id")
    return {"statements": statements, "artifacts": artifacts, "events": events}


def commit(batch: dict[str, DataFrame], path: str, batch_id: str) -> None:
    """Writes a confirmed batch and then its marker, by which readers know it. Doing it again replaces the same batch."""
    for name in TABLES:
        batch[name].write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
    spark = batch["statements"].sparkSession
    spark.createDataFrame([(batch_id,)], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{path}/done/of={batch_id}")


def committed(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table's rows of the batches whose marker is there; None before the first."""
    if not folders.exists(spark, f"{path}/done"):
        return None
    done = spark.read.option("recursiveFileLookup", "true").schema("batch string").parquet(f"{path}/done")
    rows = spark.read.parquet(f"{path}/{name}").withColumn("batch", F.col("batch").cast("string"))
    return rows.join(done.distinct(), "batch", "left_semi").drop("batch")
