"""Views over the log: transactions, duplicates, statement coverage and overlap, pairings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowmere.functions.columns import overlaps


def transactions_view(rows: DataFrame, excluded: DataFrame) -> DataFrame:
    """Every row with whether it counts and, if not, why."""
    out = rows.join(excluded, ["user_id", "seq"], "left")
    return out.withColumn("is_counted", F.col("reason").isNull())


def totals(view: DataFrame, income: str, expense: str) -> DataFrame:
    """Income, expense and excluded rows by user. `income` and `expense`: SQL conditions on rows."""
    counted = F.col("is_counted")
    return view.groupBy("user_id").agg(
        F.coalesce(F.sum(F.when(counted & F.expr(income), F.col("amount_paise"))), F.lit(0)).alias("income_paise"),
        F.coalesce(F.sum(F.when(counted & F.expr(expense), F.abs("amount_paise"))), F.lit(0)).alias("expense_paise"),
        F.count_if(~counted).alias("excluded_count"),
        F.count("*").alias("transaction_count"),
    )


#: Days of a bucket of the interval joins.
BUCKET_DAYS = 32


def _bucket_of(date: str | F.Column) -> F.Column:
    return F.floor(F.unix_date(date) / BUCKET_DAYS).cast("int")


def bucketed(periods: DataFrame) -> DataFrame:
    """Periods once for each bucket of days that they touch; a missing bound means none."""
    start, end = F.least("period_start", "period_end"), F.greatest("period_start", "period_end")
    known = periods.where("period_start IS NOT NULL AND period_end IS NOT NULL")
    return known.withColumn("bucket", F.explode(F.sequence(_bucket_of(start), _bucket_of(end))))


def covering(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """How many statements, not rejected, cover each row's date, and their ids in order.

    A row meets the periods of its account that touch its bucket of days, not all of the account's.
    """
    p = bucketed(periods.where("status <> 'rejected'").select("user_id", "account_ref", "period_start", "period_end", "ingestion_event_id"))
    keys = ["user_id", "account_ref", "bucket"]
    r = rows.select("user_id", "seq", "account_ref", "value_date", _bucket_of("value_date").alias("bucket")).alias("r")
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"r.{k}") == F.col(f"p.{k}")
    met = r.join(p.alias("p"), same & F.col("r.value_date").between(F.col("p.period_start"), F.col("p.period_end")), "left")
    out = met.groupBy("r.user_id", "r.seq").agg(F.count("p.ingestion_event_id").alias("covering_count"), F.array_join(F.array_sort(F.collect_set("p.ingestion_event_id")), ",").alias("covering_ids"))
    return out.select("user_id", "seq", "covering_count", "covering_ids")


def overlap_pairs(periods: DataFrame) -> DataFrame:
    """(ingestion_event_id, other) of statements, not rejected, of one account whose periods meet, each way once.

    Periods meet in the buckets that both touch; a pair counts in that of the later start alone.
    """
    p = bucketed(periods.where("status <> 'rejected'").select("user_id", "account_ref", "ingestion_event_id", "period_start", "period_end"))
    a, b = p.alias("a"), p.alias("b")
    same = (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.account_ref") == F.col("b.account_ref")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.ingestion_event_id") != F.col("b.ingestion_event_id"))
    here = F.col("a.bucket") == _bucket_of(F.greatest("a.period_start", "b.period_start"))
    met = a.join(b, same & here & overlaps(F.col("a.period_start"), F.col("a.period_end"), F.col("b.period_start"), F.col("b.period_end")))
    return met.select(F.col("a.ingestion_event_id").alias("ingestion_event_id"), F.col("b.ingestion_event_id").alias("other"))


def overlap_map(periods: DataFrame) -> DataFrame:
    """Each statement, not rejected, with the others of its account whose period meets its own."""
    met = overlap_pairs(periods).groupBy("ingestion_event_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("other")), ",").alias("ids"))
    all_ = periods.where("status <> 'rejected'").select("ingestion_event_id").distinct().join(met, "ingestion_event_id", "left")
    return all_.select("ingestion_event_id", F.coalesce("n", F.lit(0)).alias("overlap_count"), F.coalesce("ids", F.lit("")).alias("overlapping_ids"))


def sync_history(periods: DataFrame, as_of: str, stall_days: int = 35) -> DataFrame:
    """Statements with whether their account's sync has stalled by `as_of` (a date)."""
    return periods.select("ingestion_event_id", "user_id", "account_ref", "status", "period_end", (F.datediff(F.lit(as_of).cast("date"), "period_end") > stall_days).alias("is_stalled"))


def pairings(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Decisions with their legs' roles, accounts and dates."""
    leg = lambda side: rows.select("user_id", F.col("seq").alias(f"{side}_seq"), F.col("account_ref").alias(f"{side}_account"), F.col("value_date").alias(f"{side}_date"))
    roles = F.when(F.col("matched_by") == "transfer", "debit/credit").when(F.col("matched_by") == "credit_card_payment", "savings_debit/cc_credit").when(F.col("matched_by") == "fd_booking", "savings_debit/fd_credit").otherwise("original/reversal")
    out = pairs.join(leg("debit"), ["user_id", "debit_seq"], "left").join(leg("credit"), ["user_id", "credit_seq"], "left")
    return out.select("user_id", "matched_by", "confidence", roles.alias("roles"), "debit_seq", "credit_seq", F.coalesce("debit_account", F.lit("")).alias("debit_account"), F.coalesce("credit_account", F.lit("")).alias("credit_account"), "debit_date", "credit_date")


def sync_report(statements: DataFrame, now: F.Column, stall_days: int = 35) -> DataFrame:
    """Statements newest first with their counts, and whether each was made more than `stall_days` before `now`.

    `statements`: ingestion_event_id, user_id, account_ref, layout, period_start, period_end, status, records_added,
    records_skipped, balance_check, confidence, created_at.
    """
    stalled = F.col("created_at") < now - F.make_interval(days=F.lit(stall_days))
    columns = ["user_id", "ingestion_event_id", "account_ref", "layout", "period_start", "period_end", "status", "records_added", "records_skipped", "balance_check", "confidence", "created_at"]
    return statements.select(*columns, stalled.alias("is_stalled")).orderBy("user_id", F.desc("created_at"), "ingestion_event_id")


#: The roles of a decision's legs.
ROLES = {"transfer": ("debit", "credit"), "credit_card_payment": ("savings_debit", "cc_credit"), "fd_booking": ("savings_debit", "fd_credit"), "reversal": ("original", "reversal")}


def pairing_report(pairs: DataFrame, rows: DataFrame, periods: DataFrame) -> DataFrame:
    """Decisions, newest first, with both legs: role, hash, account and the period of the statement that brought it.

    A leg that isn't known, or whose statement isn't, has an empty account and no period. A decision is dated as its
    debit. `rows`: user_id, seq, idempotency_hash, account_ref, value_date, ingestion_event_id.
    """
    known = rows.join(periods.select("ingestion_event_id", "period_start", "period_end"), "ingestion_event_id").select("user_id", "seq", "account_ref", "period_start", "period_end")
    out = pairs
    for k, side in enumerate(("debit", "credit")):
        meta = known.select("user_id", F.col("seq").alias(f"{side}_seq"), F.struct(F.col("account_ref"), F.col("period_start"), F.col("period_end")).alias(f"_{side}"))
        hashes = rows.select("user_id", F.col("seq").alias(f"{side}_seq"), F.col("idempotency_hash").alias(f"_{side}_hash"), *([F.col("value_date")] if k == 0 else []))
        out = out.join(hashes, ["user_id", f"{side}_seq"], "left").join(meta, ["user_id", f"{side}_seq"], "left")
    role = lambda k: F.create_map(*[F.lit(x) for name, roles in ROLES.items() for x in (name, roles[k])])[F.col("matched_by")]
    leg = lambda k, side: F.struct(role(k).alias("role"), F.col(f"_{side}_hash").alias("idempotency_hash"), F.coalesce(F.col(f"_{side}.account_ref"), F.lit("")).alias("account_ref"), F.col(f"_{side}.period_start").alias("period_start"), F.col(f"_{side}.period_end").alias("period_end"))
    out = out.select("user_id", "matched_by", "confidence", "value_date", "debit_seq", "credit_seq", F.array(leg(0, "debit"), leg(1, "credit")).alias("legs"))
    return out.orderBy("user_id", F.desc("value_date"), F.desc(F.greatest("debit_seq", "credit_seq")))
