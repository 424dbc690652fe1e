"""Ledger-shaped inputs made from the test tables, whole tables each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallowmere.schema import CATEGORIES

#: Narrations of the eight kinds of rows.
TEXTS = ["Swiggy  order", "ZOMATO ltd", "amazon pay", "ATM wdl", "NEFT CR salary", "IMPS p2a", "UPI ref", "Rent  paid"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as bank rows: user, seq, account, signed paise, date, narration."""
    e = _read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "credit_card").when(F.col("event_type") == "error", "fd").otherwise("savings")
    prefix = F.when(F.col("event_type") == "purchase", "CARD_").when(F.col("event_type") == "error", "FD_").otherwise("SAV_")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0))
    size = F.floor(F.col("value") / 20).cast("bigint") * 2000 + 2000
    return e.select(
        F.col("user_id").cast("bigint").alias("user_id"),
        F.col("event_id").alias("seq"),
        kind.alias("account_type"),
        F.concat(prefix, (F.col("user_id") % 2).cast("string")).alias("account_ref"),
        (F.when(F.col("event_id") % 2 == 0, -1).otherwise(1) * size).alias("amount_paise"),
        F.to_date("ts").alias("value_date"),
        F.element_at(F.array(*map(F.lit, TEXTS)), (F.pmod(k, F.lit(8)) + 1).cast("int")).alias("narration"),
        k.alias("k"),
    )


def statements(txn: DataFrame) -> DataFrame:
    """One statement for each account and week; some don't add up."""
    week = F.trunc("value_date", "week")
    rows = txn.groupBy("user_id", "account_ref", "account_type", week.alias("period_start")).agg(F.sum("amount_paise").alias("net"), F.count("*").alias("row_count"), F.max("seq").alias("last_seq"))
    upto = W.partitionBy("user_id", "account_ref").orderBy("period_start").rowsBetween(W.unboundedPreceding, 0)
    total = F.lit(100000) + F.sum("net").over(upto)
    wrong = F.when((F.col("user_id") % 11 == 0) & (F.col("row_count") % 3 == 0), 1).otherwise(0)
    return rows.select(
        F.concat_ws("/", "account_ref", F.col("user_id").cast("string"), F.date_format("period_start", "yyyy-MM-dd")).alias("ingestion_event_id"),
        "user_id",
        "account_ref",
        "account_type",
        "period_start",
        F.date_add("period_start", 6).alias("period_end"),
        (total - F.col("net")).alias("opening_paise"),
        (total + wrong).alias("closing_paise"),
        "row_count",
        F.col("last_seq").alias("seq"),
        F.col("net"),
    )


def statement_periods(txn: DataFrame) -> DataFrame:
    """`statements` with longer periods, rejected ones and unknown closings among them, and their balance check."""
    s = statements(txn)
    return s.select(
        "ingestion_event_id",
        "user_id",
        "account_ref",
        "account_type",
        "period_start",
        F.when(F.col("user_id") % 13 == 0, F.date_add("period_end", 3)).otherwise(F.col("period_end")).alias("period_end"),
        F.when((F.col("user_id") % 17 == 0) & (F.col("seq") % 4 == 0), "rejected").otherwise("ingested").alias("status"),
        "opening_paise",
        F.when(~((F.col("user_id") % 19 == 0) & (F.col("seq") % 5 == 0)), F.col("closing_paise")).alias("closing_paise"),
        F.when(F.col("opening_paise") + F.col("net") == F.col("closing_paise"), "pass").otherwise("fail").alias("balance_check"),
        "row_count",
        "seq",
    )


def ledger_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as rows over years, with a category or none."""
    names = F.array(*map(F.lit, CATEGORIES))
    slot = F.pmod(F.col("o_orderkey"), F.lit(17))
    paise = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return _read(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 200).cast("bigint").alias("user_id"),
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("SAV_"), (F.col("o_custkey") % 3).cast("string")).alias("account_ref"),
        F.to_date("o_orderdate").alias("value_date"),
        F.when(F.col("o_orderstatus") == "O", paise).otherwise(-paise).alias("amount_paise"),
        F.when(slot < 16, F.element_at(names, (F.least(slot, F.lit(15)) + 1).cast("int"))).alias("category"),
    )
