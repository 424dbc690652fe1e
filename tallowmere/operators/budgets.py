"""Spend, budgets, key figures and trends over categorised rows (user_id, seq, value_date, amount_paise, category)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallowmere.functions.columns import basis_points
from tallowmere.operators.classify import nature
from tallowmere.schema import EXPENSE


def month() -> F.Column:
    return F.trunc("value_date", "month").alias("month")


def net_spend(rows: DataFrame) -> DataFrame:
    """spent_paise by user, expense category and calendar month; refunds count against it, and may exceed it."""
    return rows.where(F.col("category").isin(EXPENSE)).groupBy("user_id", "category", month()).agg((-F.sum("amount_paise")).alias("spent_paise"))


def checked_once(rows: DataFrame, identity: str) -> DataFrame:
    """One row for each identity; rows that share one but differ otherwise raise an error."""
    same = F.struct("amount_paise", "value_date", "category")
    out = rows.groupBy("user_id", identity).agg(F.min_by(F.struct(*rows.columns), "seq").alias("r"), F.min(same).alias("a"), F.max(same).alias("b"))
    return out.where(F.when(F.col("a") == F.col("b"), True).otherwise(F.raise_error(F.lit("rows of one identity differ")).cast("boolean"))).select("r.*")


def utilisation(budgets: DataFrame, spend: DataFrame) -> DataFrame:
    """spent, remaining and used basis points (rounded down, none for a limit of zero) of every budget."""
    out = budgets.join(spend, ["user_id", "category", "month"], "left").withColumn("spent_paise", F.coalesce("spent_paise", F.lit(0)))
    share = basis_points(F.col("spent_paise"), F.col("target_paise"))
    return out.select("user_id", "category", "month", "target_paise", "spent_paise", (F.col("target_paise") - F.col("spent_paise")).alias("remaining_paise"), F.when(F.col("target_paise") > 0, F.greatest(F.lit(0), share)).otherwise(F.lit(0)).cast("bigint").alias("used_bps"))


def key_figures(rows: DataFrame, by: list) -> DataFrame:
    """Expense (refunds against it), income, refunds, net cashflow and savings rate."""
    expense = F.col("category").isin(EXPENSE)
    open_debit = F.col("category").isNull() & (F.col("amount_paise") < 0)
    amount = F.col("amount_paise")
    total = lambda when, value=amount: F.coalesce(F.sum(F.when(F.coalesce(when, F.lit(False)), value)), F.lit(0))
    out = rows.groupBy(*by).agg(
        total(expense | open_debit, -amount).alias("expense_paise"),
        total((F.col("category") == "income") & (amount > 0)).alias("income_paise"),
        total(expense & (amount > 0)).alias("refund_paise"),
        total(expense, -amount).alias("categorised_paise"),
        total(open_debit, -amount).alias("uncategorised_paise"),
    )
    net = F.col("income_paise") - F.col("expense_paise")
    rate = basis_points(net, F.col("income_paise"))
    return out.withColumn("net_paise", net).withColumn("savings_bps", F.when(F.col("income_paise") > 0, rate))


def running_cost(rows: DataFrame) -> DataFrame:
    """Spend by user and nature, and the running part (fixed and variable essentials)."""
    spent = rows.withColumn("nature", nature(F.col("category"))).where("nature IS NOT NULL")
    part = lambda n: F.coalesce(F.sum(F.when(F.col("nature") == n, -F.col("amount_paise"))), F.lit(0))
    out = spent.groupBy("user_id").agg(*[part(n).alias(n) for n in ("essential_fixed", "essential_variable", "discretionary", "luxury")])
    return out.withColumn("running_paise", F.col("essential_fixed") + F.col("essential_variable"))


def trend(figures: DataFrame, value: str, by: str = "user_id") -> DataFrame:
    """`value` by month with the change from the month before that has one."""
    before = F.lag(value).over(W.partitionBy(by).orderBy("month"))
    return figures.select(by, "month", value, (F.col(value) - before).alias("change"))


def top_by(rows: DataFrame, name: str, k: int = 10) -> DataFrame:
    """The k names with most spend of each user, ties by name."""
    spent = rows.where(F.col(name).isNotNull()).groupBy("user_id", name).agg((-F.sum("amount_paise")).alias("spent_paise"))
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("spent_paise"), name))
    return spent.withColumn("place", place).where(F.col("place") <= k)
