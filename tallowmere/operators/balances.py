"""Account balances anchored to the last statement that adds up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowmere.schema import LEDGER_BROKEN, NOT_SUPPORTED, ROW_UNREADABLE, STATEMENT_TYPES, STATEMENT_UNREADABLE, TYPE_MISMATCH, TYPE_MISSING

KEY = ["user_id", "account_ref"]


def anchors(periods: DataFrame) -> DataFrame:
    """The statement each account's balance starts from: passed, closing known, latest period, then latest seq."""
    fine = periods.where("status = 'ingested' AND balance_check = 'pass' AND closing_paise IS NOT NULL")
    best = fine.groupBy(*KEY).agg(F.max_by(F.struct("ingestion_event_id", "closing_paise", "period_end", "seq"), F.struct("period_end", "seq")).alias("a"))
    return best.select(*KEY, F.col("a.ingestion_event_id").alias("anchor_id"), F.col("a.closing_paise").alias("anchor_paise"), F.col("a.period_end").alias("anchor_end"))


def balances(legs: DataFrame, periods: DataFrame) -> DataFrame:
    """balance_paise (null: no anchor) and is_stale of every account.

    A leg counts by the statement that brought it, not by its date: it is added if that statement ends after
    the anchor. A leg without a known statement makes the balance stale and isn't added. `legs` has
    ingestion_event_id and, for identity, idempotency_hash or seq.
    """
    identity = "idempotency_hash" if "idempotency_hash" in legs.columns else "seq"
    once = legs.groupBy(*KEY, F.col(identity).alias("_id")).agg(F.min_by(F.struct("amount_paise", "ingestion_event_id"), "seq").alias("l")).select(*KEY, "l.*")
    ends = periods.select("ingestion_event_id", F.col("period_end").alias("leg_end"))
    placed = once.join(ends, "ingestion_event_id", "left").join(anchors(periods), KEY, "left")
    after = F.sum(F.when(F.col("leg_end") > F.col("anchor_end"), F.col("amount_paise")))
    out = placed.groupBy(*KEY).agg(F.first("anchor_id").alias("anchor_id"), F.first("anchor_paise").alias("anchor_paise"), after.alias("after"), F.bool_or(F.col("leg_end").isNull()).alias("unplaced"))
    known = F.col("anchor_paise").isNotNull()
    return out.select(*KEY, "anchor_id", F.when(known, F.col("anchor_paise") + F.coalesce("after", F.lit(0))).alias("balance_paise"), (known & F.col("unplaced")).alias("is_stale"))


def liabilities(balance: DataFrame) -> DataFrame:
    """What is owed on cards: the balance with its sign turned, null where unknown."""
    return balance.where("account_ref LIKE 'CARD%'").select(*KEY, (-F.col("balance_paise")).alias("liability_paise"))


def type_mismatches(accounts: DataFrame, periods: DataFrame) -> DataFrame:
    """Accounts whose statements have another type than the account (current accounts print savings statements)."""
    seen = periods.groupBy(*KEY).agg(F.array_sort(F.collect_set("account_type")).alias("types"))
    expected = F.when(F.col("account_type") == "current", "savings").otherwise(F.col("account_type"))
    other = F.array_except("types", F.array(expected))
    return accounts.join(seen, KEY).select(*KEY, "account_type", F.array_join(other, ",").alias("other_types")).where("other_types <> ''")


def reports(accounts: DataFrame, periods: DataFrame, legs: DataFrame) -> DataFrame:
    """Each account's balance or liability, or the code of what stands against it; one account's fault leaves the others alone.

    `accounts`: (user_id, account_ref, account_type). `periods` and `legs` may have `readable`, false where a
    payload couldn't be opened; a readable leg without an amount breaks the account's ledger.
    """
    periods, legs = (t if "readable" in t.columns else t.withColumn("readable", F.lit(True)) for t in (periods, legs))
    expected = F.create_map(*[F.lit(x) for pair in STATEMENT_TYPES.items() for x in pair])[F.col("account_type")]
    kinds = periods.groupBy(*KEY).agg(F.bool_or(~F.col("readable")).alias("closed"), F.collect_set(F.when(F.col("readable"), F.col("account_type"))).alias("types"))
    faults = legs.groupBy(*KEY).agg(F.bool_or(~F.col("readable")).alias("shut"), F.bool_or(F.col("readable") & F.col("amount_paise").isNull()).alias("broken"))
    found = balances(legs, periods.where("readable")).join(anchors(periods.where("readable")).select(*KEY, "anchor_end", "anchor_paise"), KEY, "full")
    out = accounts.join(kinds, KEY, "left").join(faults, KEY, "left").join(found, KEY, "left").withColumn("expected", expected)
    code = (
        F.when(F.col("account_type").isNull(), TYPE_MISSING)
        .when(F.col("expected").isNull(), NOT_SUPPORTED)
        .when(F.col("closed"), STATEMENT_UNREADABLE)
        .when(F.size(F.array_except(F.coalesce("types", F.array().cast("array<string>")), F.array("expected"))) > 0, TYPE_MISMATCH)
        .when(F.col("shut"), ROW_UNREADABLE)
        .when(F.col("broken"), LEDGER_BROKEN)
    )
    out = out.withColumns({"code": code, "balance": F.coalesce("balance_paise", "anchor_paise")})
    fine, card = F.col("code").isNull(), F.col("expected") == "credit_card"
    return out.select(*KEY, "account_type", "code", F.when(fine & ~card, F.col("balance")).alias("derived_balance_paise"), F.when(fine & card, -F.col("balance")).alias("outstanding_liability_paise"), F.when(fine, F.col("anchor_end")).alias("anchor_period_end"), F.when(fine, F.coalesce("is_stale", F.lit(False))).alias("is_stale"))
