"""Uploads from extracted statements to the log: read by layout, checked against their own balances, committed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowmere.sources import commits, folders, statements

HEAD = "ingestion_event_id string, user_id bigint, layout string, account_ref string, account_type string, period_start date, period_end date, opening_paise bigint, closing_paise bigint, balance_check string, confidence int, content_hash string, status string, records_added bigint, records_skipped bigint"
ROW = "ingestion_event_id string, user_id bigint, account_ref string, account_type string, value_date date, amount_paise bigint, narration string, canonical_narration string, occurrence_index int, running_balance_paise bigint, source_seq int, idempotency_hash string"


def prepared(texts: DataFrame, cells: DataFrame, words: DataFrame, owners: DataFrame, layouts: list = statements.LAYOUTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Statements and rows as `commits.commit` takes them, and the statements that don't read, with the reason.

    `owners`: (statement_id, user_id); a statement of nobody is left out. The content hash is that of the text. A
    statement's headers are written first, as two of the three come from them.
    """
    heads, rows = statements.read(texts, cells, words, layouts)
    owners = folders.kept(owners, "owners")
    heads = heads.join(owners, "statement_id").join(texts.select("statement_id", F.sha2("text", 256).alias("content_hash")), "statement_id")
    heads = folders.kept(heads, "heads")
    fine = heads.where("reason IS NULL").select(F.col("statement_id").alias("ingestion_event_id"), "user_id", "layout", "account_ref", "account_type", "period_start", "period_end", "opening_paise", "closing_paise", "balance_check", "confidence", "content_hash")
    kinds = F.create_map(*[F.lit(x) for one in layouts for x in (one.name, one.account_type)])
    legs = rows.join(owners, "statement_id").select(F.col("statement_id").alias("ingestion_event_id"), "user_id", "account_ref", kinds[F.col("layout")].alias("account_type"), "value_date", "amount_paise", "narration", "canonical_narration", "occurrence_index", "running_balance_paise", F.col("pos").alias("source_seq"), "idempotency_hash")
    return fine, legs, heads.where("reason IS NOT NULL").select("statement_id", "user_id", "layout", "reason")


def intake(texts: DataFrame, cells: DataFrame, words: DataFrame, owners: DataFrame, path: str, batch: str, strict: bool = True) -> DataFrame:
    """Brings a batch of uploads into the log at `path` and gives the statements that don't read, with the reason.

    What was read is written beside the log under names of its own, and the commit works from that.
    """
    fine, rows, refused = prepared(texts, cells, words, owners)
    commits.commit(fine, folders.kept(rows, "rows"), path, batch, strict)
    return refused
