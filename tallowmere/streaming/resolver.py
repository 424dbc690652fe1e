"""The resolver over a stream of new rows: each batch adds decisions and changes none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallowmere.operators.resolve import resolve_new

PAIR = "user_id bigint, debit_seq bigint, credit_seq bigint, matched_by string, confidence int"


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """What is stored so far; empty before the first batch."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def start(rows: DataFrame, log_path: str, decisions_path: str, checkpoint: str) -> StreamingQuery:
    """Reads streaming `rows` (user_id, seq, account_type, amount_paise, value_date), stores them and the decisions they make.

    Batches are stored under their number, so one that is run again after a failure replaces itself, and its
    decisions are made from what earlier batches left.
    """
    spark = rows.sparkSession

    def batch(new: DataFrame, number: int) -> None:
        schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in new.schema)}, batch bigint"
        spark_ = new.sparkSession
        before = _stored(spark_, log_path, schema).where(F.col("batch") < number)
        known = before.select("user_id", "seq")
        new = new.dropDuplicates(["user_id", "seq"]).join(known, ["user_id", "seq"], "left_anti")
        new.write.mode("overwrite").parquet(f"{log_path}/batch={number}")
        fresh = spark_.read.parquet(f"{log_path}/batch={number}")
        decided = _stored(spark_, decisions_path, f"{PAIR}, batch bigint").where(F.col("batch") < number).drop("batch")
        touched = fresh.select("user_id", F.abs("amount_paise").alias("size")).distinct()
        old = before.drop("batch").withColumn("size", F.abs("amount_paise")).join(touched, ["user_id", "size"], "left_semi").drop("size")
        pairs = resolve_new(old.unionByName(fresh.select(old.columns)), decided, -1)
        pairs.write.mode("overwrite").parquet(f"{decisions_path}/batch={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
