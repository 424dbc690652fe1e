"""Statement rows before they enter the log: identity, ordinals, balance checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallowmere.functions.columns import canonical, canonical_ascii, identity_hash


def with_occurrence(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """occurrence_index: earlier rows, in source order, with the same `keys`."""
    return rows.withColumn("occurrence_index", (F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1).cast("int"))


def with_canonical(rows: DataFrame) -> DataFrame:
    """canonical_narration; only rows whose narration goes beyond ASCII pass through Python."""
    plain = F.coalesce(~F.col("narration").rlike(r"[^\x00-\x7F]"), F.lit(True))
    return rows.where(plain).withColumn("canonical_narration", canonical_ascii(F.col("narration"))).unionByName(rows.where(~plain).withColumn("canonical_narration", canonical(F.col("narration"))))


def with_identity(rows: DataFrame) -> DataFrame:
    """canonical_narration, occurrence_index and idempotency_hash of (user_id, account_ref, value_date, amount_paise, narration) rows."""
    rows = with_canonical(rows)
    rows = with_occurrence(rows, ["user_id", "account_ref", "value_date", "amount_paise", "canonical_narration"])
    return rows.withColumn("idempotency_hash", identity_hash(*map(F.col, ["account_ref", "value_date", "amount_paise", "canonical_narration", "occurrence_index"])))


def balance_check(opening: Column, closing: Column, net: Column, rows: Column) -> Column:
    """pass, fail or not_applicable: whether the opening and the rows make the closing."""
    unknown = opening.isNull() | closing.isNull()
    return F.when(unknown & (rows > 0), "fail").when(unknown, "not_applicable").when(opening + F.coalesce(net, F.lit(0)) == closing, "pass").otherwise("fail")


def infer_balances(rows: DataFrame, keys: list[str]) -> DataFrame:
    """opening and closing of each statement from its rows' running balances: first balance less first amount, last balance."""
    first, last = F.struct("running_balance_paise", "amount_paise"), F.col("running_balance_paise")
    out = rows.groupBy(*keys).agg(F.min_by(first, "seq").alias("f"), F.max_by(last, "seq").alias("closing_paise"))
    return out.select(*keys, (F.col("f.running_balance_paise") - F.col("f.amount_paise")).alias("opening_paise"), "closing_paise")


def with_running_balance(rows: DataFrame, keys: list[str], opening: str) -> DataFrame:
    upto = W.partitionBy(*keys).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("running_balance_paise", F.col(opening) + F.sum("amount_paise").over(upto))


def new_rows(rows: DataFrame, log: DataFrame, strict: bool = False) -> DataFrame:
    """Rows whose (user, hash) the log lacks. Strict: a statement with any known row is left out whole."""
    known = log.select("user_id", "idempotency_hash").distinct()
    fresh = rows.dropDuplicates(["user_id", "idempotency_hash"]).join(known, ["user_id", "idempotency_hash"], "left_anti")
    if not strict:
        return fresh
    clash = rows.join(known, ["user_id", "idempotency_hash"], "left_semi").select("user_id", "ingestion_event_id").distinct()
    return fresh.join(clash, ["user_id", "ingestion_event_id"], "left_anti")
