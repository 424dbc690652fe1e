"""Dashboard series behind one time selector: months, quarters and fiscal years on a calendar without gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallowmere.functions.columns import basis_points
from tallowmere.operators.classify import nature
from tallowmere.schema import EXPENSE

#: Months of each grain; quarters and years begin in April.
GRAINS = {"month": 1, "quarter": 3, "fiscal_year": 12}


def period_start(date: Column, grain: str) -> Column:
    """The first day of the month, quarter or fiscal year of a date."""
    month = F.trunc(date, "month")
    return F.add_months(month, -F.pmod(F.month(month) - 4, F.lit(GRAINS[grain])))


def _each_grain(date: Column) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(g).alias("grain"), period_start(date, g).alias("period")) for g in GRAINS])).alias("g")


def _month_sums(rows: DataFrame, merchant: str) -> DataFrame:
    """One row for each user, month, category and merchant: what all series add up."""
    expense, amount = F.col("category").isin(EXPENSE), F.col("amount_paise")
    total = lambda when, value: F.coalesce(F.sum(F.when(F.coalesce(when, F.lit(False)), value)), F.lit(0))
    return rows.where("value_date IS NOT NULL").groupBy("user_id", F.trunc("value_date", "month").alias("month"), "category", F.col(merchant).alias("merchant")).agg(
        total(F.col("category").isNull() & (amount < 0), -amount).alias("open"), total(expense, -amount).alias("spent"), total((F.col("category") == "income") & (amount > 0), amount).alias("income"),
        F.sum(-amount).alias("out"),
    )


def series(rows: DataFrame, merchant: str, start: str | None = None, end: str | None = None, top: int = 10) -> DataFrame:
    """(user_id, grain, period, series, key, value, previous, change, place) of seven series for every grain.

    `rows`: user_id, value_date, amount_paise, category and a merchant. The selector `start` to `end` (dates, both
    included) holds for all series; without it a user's periods run from the first to the last with rows. Periods
    without rows are there with zeros, so `previous` is always the period before. income and expense are two keys
    of one series, a category's share is in basis points of the period's expense (null if that isn't positive), the
    savings rate is null without income. Merchants are ranked by spend, then name, and carry their place.
    """
    chosen = rows if start is None else rows.where(F.col("value_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    sums = _month_sums(chosen, merchant).select("*", _each_grain(F.col("month"))).select("user_id", "g.grain", "g.period", "category", "merchant", "open", "spent", "income", "out")
    bounds = sums.groupBy("user_id", "grain").agg(F.min("period").alias("a"), F.max("period").alias("b"))
    if start is not None:
        pick = lambda date: F.coalesce(*[F.when(F.col("grain") == g, period_start(F.lit(date).cast("date"), g)) for g in GRAINS])
        bounds = bounds.withColumns({"a": pick(start), "b": pick(end)})
    months = F.coalesce(*[F.when(F.col("grain") == g, n) for g, n in GRAINS.items()])
    steps = F.sequence(F.lit(0), (F.months_between("b", "a") / months).cast("int"))
    spine = bounds.select("user_id", "grain", F.explode(F.transform(steps, lambda k: F.add_months("a", (k * months).cast("int")))).alias("period"))

    by = ["user_id", "grain", "period"]
    whole = spine.join(sums.groupBy(*by).agg(F.sum(F.col("open") + F.col("spent")).alias("expense"), F.sum("income").alias("income")), by, "left").na.fill(0, ["expense", "income"])
    net = F.col("income") - F.col("expense")
    rate = F.when(F.col("income") > 0, basis_points(net, F.col("income")))
    item = lambda name, key, value: F.struct(F.lit(name).alias("series"), F.lit(key).alias("key"), value.cast("bigint").alias("value"))
    wide = whole.select(*by, F.explode(F.array(item("income_expense", "income", F.col("income")), item("income_expense", "expense", F.col("expense")), item("net_cashflow", "net", net), item("savings_rate", "bps", rate))).alias("i")).select(*by, "i.*")

    def keyed(name: str, key: Column, value: str) -> DataFrame:
        """A series of several keys, each over all periods of its user."""
        mine = sums.withColumn("key", key).where("key IS NOT NULL").groupBy(*by, "key").agg(F.sum(value).alias("value"))
        keys = mine.select("user_id", "grain", "key").distinct()
        return spine.join(keys, ["user_id", "grain"]).join(mine, [*by, "key"], "left").select(*by, F.lit(name).alias("series"), "key", F.coalesce("value", F.lit(0)).alias("value"))

    categories = keyed("category_trend", F.when(F.col("category").isin(EXPENSE), F.col("category")), "spent")
    share = F.when(F.col("expense") > 0, basis_points(F.col("value"), F.col("expense")))
    split = categories.join(whole.select(*by, "expense"), by).select(*by, F.lit("category_split").alias("series"), "key", share.alias("value"))
    natures = keyed("nature_split", nature(F.col("category")), "spent")
    steady = wide.unionByName(categories).unionByName(split).unionByName(natures)
    before = F.lag("value").over(W.partitionBy("user_id", "grain", "series", "key").orderBy("period"))
    steady = steady.withColumn("previous", before).withColumns({"change": F.col("value") - F.col("previous"), "place": F.lit(None).cast("int")})
    spent = sums.where("merchant IS NOT NULL").groupBy(*by, "merchant").agg(F.sum("out").alias("value"))
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("value"), "merchant"))
    none = F.lit(None).cast("bigint")
    ranked = spent.withColumn("place", place).where(F.col("place") <= top).select(*by, F.lit("top_merchants").alias("series"), F.col("merchant").alias("key"), "value", none.alias("previous"), none.alias("change"), "place")
    return steady.unionByName(ranked)
