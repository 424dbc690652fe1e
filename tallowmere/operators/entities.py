"""Accounts, budgets and keys: request checks, and current rows derived from their changes in order of `seq`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallowmere.schema import EXPENSE, KEPT_ACCOUNT_TYPES

DUPLICATE = "budget_duplicate"


def _wrong(checks: dict[str, Column]) -> Column:
    """The fields that fail, in order, joined by commas; null if none. A check that gives null has failed."""
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(fine, F.lit(False)), name) for name, fine in checks.items()]))
    return F.when(F.size(bad) > 0, F.array_join(bad, ","))


def wrong_budget(category: Column, month: Column, target: Column) -> Column:
    """Budgets are for expense categories, from the first of a month, above zero."""
    return _wrong({"category": category.isin(EXPENSE), "month": F.dayofmonth(month) == 1, "target_paise": target > 0})


def wrong_account(nickname: Column, account_type: Column, last4: Column, account_ref: Column) -> Column:
    """Names and references of 1 to 128 characters, a known type, four digits or none."""
    return _wrong({
        "nickname": F.length(nickname).between(1, 128),
        "account_type": account_type.isin(KEPT_ACCOUNT_TYPES),
        "last4": last4.isNull() | last4.rlike(r"\A[0-9]{4}\z"),
        "account_ref": F.length(account_ref).between(1, 128),
    })


def accounts(changes: DataFrame) -> DataFrame:
    """Current accounts from (account_id, op, seq, user_id, account_ref, nickname, account_type, last4), op create, patch or deactivate.

    The reference is the creation's; a patch sets what isn't null; deactivated accounts stay. Changes of accounts
    that nobody created make none.
    """
    made = F.col("op") == "create"
    last = lambda name: F.max_by(name, F.when(F.col(name).isNotNull() & (F.col("op") != "deactivate"), F.col("seq"))).alias(name)
    first = lambda name: F.min_by(name, F.when(made, F.col("seq"))).alias(name)
    gone = F.bool_or(F.col("op") == "deactivate")
    out = changes.groupBy("account_id").agg(F.bool_or(made).alias("made"), first("user_id"), first("account_ref"), last("nickname"), last("account_type"), last("last4"), F.when(gone, "deactivated").otherwise("pending").alias("sync_status"))
    return out.where("made").drop("made")


BUDGET = ["user_id", "category", "month"]


def _judged(changes: DataFrame) -> DataFrame:
    """Whether each change met a budget that was there."""
    before = W.partitionBy(*BUDGET).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    there = F.last(F.when(F.col("op") != "patch", F.col("op")), ignorenulls=True).over(before) == "create"
    return changes.withColumn("there", F.coalesce(there, F.lit(False)))


def budget_outcomes(changes: DataFrame) -> DataFrame:
    """code: what each change of a budget met, null if it was done."""
    op, there = F.col("op"), F.col("there")
    return _judged(changes).withColumn("code", F.when((op == "create") & there, DUPLICATE).when((op != "create") & ~there, "not_found")).drop("there")


def budgets(changes: DataFrame) -> DataFrame:
    """Current budgets from (user_id, category, month, target_paise, op, seq), op create, patch or delete."""
    done = budget_outcomes(changes).where("code IS NULL")
    out = done.groupBy(*BUDGET).agg(F.max_by("op", "seq").alias("op"), F.max_by("target_paise", "seq").alias("target_paise"))
    return out.where("op <> 'delete'").drop("op")


def active_keys(keys: DataFrame) -> DataFrame:
    """The newest key of each user that isn't deactivated, ties to the greater key_id."""
    fine = keys.where("deactivated_at IS NULL")
    return fine.groupBy("user_id").agg(F.max_by("key_id", F.struct("created_at", "key_id")).alias("key_id"))
