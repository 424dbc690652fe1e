"""Bank and card statements whose text, table cells or placed words have been extracted: headers and rows, per layout.

Inputs: `texts` (statement_id, text); `cells` (statement_id, page, row_pos, cells array<string>);
`words` (statement_id, page, top double, x0 double, text). Rows that don't read as a transaction are left
out. A statement that no layout knows, or whose header or amounts don't read, has a reason and no rows.

`read` takes the first layout that fits, in the order of `LAYOUTS`; a further one is a `Layout` put there.
`texts_of` and `lines_of` read the extracted forms from folders.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallowmere.functions.columns import canonical, identity_hash, rupees, rupees_cr_dr
from tallowmere.operators.identity import balance_check, with_occurrence
from tallowmere.sources import folders

# columns' default boundaries, where a page prints no header; dates, amounts and lines as the layouts print them;
# and how sure the reading of a statement is, in basis points.
DEFAULT_DEPOSIT_X, DEFAULT_CLOSING_X = 400.0, 480.0
SHORT_DATE, AMOUNT, REFERENCE = r"^\d{2}/\d{2}/\d{2}$", r"^[\d,]+\.\d{2}$", r"^REF\d+$"
RUPEE = r"(?:₹|Rs\.)\s*"
SLICE_ROW = rf"(\d{{1,2}} \w{{3}} '\d{{2}})\s+(.+?)\s+(\S+)\s+{RUPEE}([\d,]+\.?\d*)\s+{RUPEE}([\d,]+\.?\d*)"
CARD_PERIOD = r"Statement Period:\s*(\d{2}/\d{2}/\d{4})\s+to\s+(\d{2}/\d{2}/\d{4})"
CARD_BALANCE = r"(?i)%s Balance:\s*([\d,]+\.\d{2}\s+(?:Cr|Dr))"
CONFIDENCE = 9000


def texts_of(spark: SparkSession, path: str) -> DataFrame:
    """`texts` from a folder with one text file a statement, named by its id."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(F.url_decode(name).alias("statement_id"), F.col("value").alias("text"))


def lines_of(spark: SparkSession, path: str, unit: str) -> DataFrame:
    """`cells` or `words` from a folder of JSON lines; a line that isn't one is left out."""
    return spark.read.schema(UNITS[unit]).option("mode", "DROPMALFORMED").json(path)


UNITS = {"texts": "statement_id string, text string", "cells": "statement_id string, page int, row_pos int, cells array<string>", "words": "statement_id string, page int, top double, x0 double, text string"}


def _date(text: Column, pattern: str) -> Column:
    """Text as a date. Two digits of a year mean 1969 to 2068."""
    out = F.try_to_date(F.trim(F.regexp_replace(text, r"\s*\n\s*", " ")), pattern)
    return F.when(F.year(out) >= 2069, F.add_months(out, -1200)).otherwise(out) if pattern.endswith("/yy") else out


def _settled(df: DataFrame, columns: list[Column]) -> DataFrame:
    """`columns` worked out once a row. Filters on them don't repeat their long expressions below, as those over a projection would."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def _found(pattern: str, group: int = 1) -> Column:
    """What the text bears of a pattern, or null."""
    return F.when(F.col("text").rlike(pattern), F.regexp_extract("text", pattern, group))


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _ordered(rows: DataFrame, *order: str) -> DataFrame:
    """Source positions of the rows that are left in each statement, from 0."""
    return rows.withColumn("pos", F.row_number().over(W.partitionBy("statement_id").orderBy(*order)) - 1)


def card_rows(cells: DataFrame, narration_from: int, amount_at: int, fallback: int | None = None) -> DataFrame:
    """Rows of a card table: date first, then narration (another cell if it is empty) and an amount with Cr or Dr."""
    c = F.col("cells")
    narration = F.get(c, F.lit(narration_from))
    if fallback is not None:
        narration = F.when(F.trim(F.coalesce(narration, F.lit(""))) != "", narration).otherwise(F.get(c, F.lit(fallback)))
    rows = cells.select("statement_id", "page", "row_pos", _date(F.regexp_extract(F.get(c, F.lit(0)), r"^\s*(\d{2}/\d{2}/\d{4})", 1), "dd/MM/yyyy").alias("value_date"), _one_line(narration).alias("narration"), rupees_cr_dr(F.get(c, F.lit(amount_at))).alias("amount_paise"))
    return _ordered(rows.where("value_date IS NOT NULL AND amount_paise IS NOT NULL AND narration <> ''"), "page", "row_pos")


def hdfc_card(cells: DataFrame) -> DataFrame:
    """Date and time, transaction, description, amount, points."""
    return card_rows(cells, 2, 3, fallback=1)


def sbi_card(cells: DataFrame) -> DataFrame:
    """Date, details, amount."""
    return card_rows(cells, 1, 2)


def sbi_savings(cells: DataFrame) -> DataFrame:
    """Transaction date, value date, description, reference, debit, credit, balance; a credit wins over a debit.

    A row whose amount or balance is written but doesn't read `is_wrong`, which its statement can't stand.
    """
    at = lambda k: F.get("cells", F.lit(k))
    debit, credit = rupees(at(4)), rupees(at(5))
    amount = F.when(F.trim(F.coalesce(at(5), F.lit(""))) != "", credit).otherwise(-debit)
    whole = cells.where((F.size("cells") >= 7) & ~F.lower(F.trim(at(0))).isin("txn date", "date", ""))
    written = F.trim(F.concat(F.coalesce(at(4), F.lit("")), F.coalesce(at(5), F.lit("")))) != ""
    balance = F.trim(F.coalesce(at(6), F.lit("")))
    wrong = amount.isNull() | ((balance != "") & rupees(balance).isNull())
    rows = whole.where(written).select("statement_id", "page", "row_pos", _date(at(1), "d MMM yyyy").alias("value_date"), _one_line(at(2)).alias("narration"), amount.alias("amount_paise"), rupees(balance).alias("running_balance_paise"), wrong.alias("is_wrong"))
    return _ordered(rows.where("value_date IS NOT NULL AND (is_wrong OR narration <> '')"), "page", "row_pos")


def hdfc_savings(words: DataFrame) -> DataFrame:
    """Words by place: a row is one height of a page, its amounts belong to columns by where they stand.

    The boundary between two columns lies midway between their headings. The second date is the value date.
    """
    lines = words.withColumn("line", F.expr("bround(top, 0)"))
    heading = lines.where(F.col("text").rlike("WithdrawalAmt|DepositAmt|ClosingBalance"))
    first = heading.where(F.col("text").contains("WithdrawalAmt")).groupBy("statement_id", "page").agg(F.min("line").alias("line"))
    x = lambda name: F.max(F.when(F.col("text").contains(name), F.col("x0")))
    heads = heading.join(first, ["statement_id", "page", "line"]).groupBy("statement_id", "page").agg(x("WithdrawalAmt").alias("w"), x("DepositAmt").alias("d"), x("ClosingBalance").alias("c"))
    bounds = heads.select("statement_id", "page", F.coalesce((F.col("w") + F.col("d")) / 2, F.lit(DEFAULT_DEPOSIT_X)).alias("to_deposit"), F.coalesce((F.col("d") + F.col("c")) / 2, F.lit(DEFAULT_CLOSING_X)).alias("to_closing"))
    rows = lines.groupBy("statement_id", "page", "line").agg(F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("ws")).where(F.col("ws")[0]["text"].rlike(SHORT_DATE))
    rows = rows.join(bounds, ["statement_id", "page"], "left").withColumns({"to_deposit": F.coalesce("to_deposit", F.lit(DEFAULT_DEPOSIT_X)), "to_closing": F.coalesce("to_closing", F.lit(DEFAULT_CLOSING_X))})
    picked = lambda when: F.element_at(F.filter("ws", lambda w: w.text.rlike(AMOUNT) & when(w.x0)).getField("text"), -1)
    last = lambda when: F.when(F.exists("ws", lambda w: w.text.rlike(AMOUNT) & when(w.x0)), picked(when))
    withdrawal, deposit = last(lambda v: v < F.col("to_deposit")), last(lambda v: (v >= F.col("to_deposit")) & (v < F.col("to_closing")))
    closing = last(lambda v: v >= F.col("to_closing"))
    dates = F.filter("ws", lambda w: w.text.rlike(SHORT_DATE)).getField("text")
    spoken = F.filter("ws", lambda w: ~w.text.rlike(SHORT_DATE) & ~w.text.rlike(AMOUNT) & ~w.text.rlike(REFERENCE)).getField("text")
    amount = F.when(deposit.isNotNull(), rupees(deposit)).otherwise(-rupees(withdrawal))
    out = rows.select("statement_id", "page", "line", _date(F.get(dates, F.lit(1)), "dd/MM/yy").alias("value_date"), _one_line(F.array_join(spoken, " ")).alias("narration"), amount.alias("amount_paise"), rupees(closing).alias("running_balance_paise"))
    return _ordered(out.where("amount_paise IS NOT NULL AND running_balance_paise IS NOT NULL AND value_date IS NOT NULL AND narration <> ''"), "page", "line")


def _spelled_year(text: Column) -> Column:
    return F.try_to_date(F.regexp_replace(text, "'", "20"), "d MMM yyyy")


def slice_savings(texts: DataFrame) -> DataFrame:
    """Lines of text; credit or debit by a word of the details, credit tried first."""
    lines = texts.select("statement_id", F.regexp_extract("text", r"Account Number\s*:\s*(\S+)", 1).alias("account"), F.posexplode(F.split("text", "\n")).alias("row_pos", "line"))
    part = lambda k: F.regexp_extract("line", SLICE_ROW, k)
    details = F.lower(part(2))
    sign = F.when(details.contains("credit") | details.contains("cr."), 1).when(details.contains("debit") | details.contains("dr."), -1)
    rows = lines.where(F.col("line").rlike(SLICE_ROW)).select("statement_id", "row_pos", F.concat(F.lit("SLICE_SAV_"), F.right("account", F.lit(4))).alias("account_ref"), _spelled_year(part(1)).alias("value_date"), _one_line(part(2)).alias("narration"), (sign * rupees(part(4))).alias("amount_paise"), rupees(part(5)).alias("running_balance_paise"))
    return _ordered(rows.where("value_date IS NOT NULL AND amount_paise IS NOT NULL"), "row_pos")


def card_header() -> dict[str, Column]:
    return {"account_ref": F.coalesce(_found(r"Account:\s*(\S+)"), F.lit("")), "period_start": _date(_found(CARD_PERIOD), "dd/MM/yyyy"), "period_end": _date(_found(CARD_PERIOD, 2), "dd/MM/yyyy"), "opening_paise": rupees_cr_dr(_found(CARD_BALANCE % "Previous")), "closing_paise": rupees_cr_dr(_found(CARD_BALANCE % "New"))}


def hdfc_savings_header() -> dict[str, Column]:
    period = r"StatementFrom\s*:\s*(\d{2}/\d{2}/\d{4})\s+To\s*:\s*(\d{2}/\d{2}/\d{4})"
    return {"account_ref": F.coalesce(_found(r"AccountNo\s*:\s*(\S+)"), F.lit("")), "period_start": _date(_found(period), "dd/MM/yyyy"), "period_end": _date(_found(period, 2), "dd/MM/yyyy")}


def sbi_savings_header() -> dict[str, Column]:
    period = r"Account Statement from (\d{1,2} \w{3} \d{4}) to (\d{1,2} \w{3} \d{4})"
    return {"account_ref": F.coalesce(_found(r"Account Number\s*:\s*(\S+)"), F.lit("")), "period_start": _date(_found(period), "d MMM yyyy"), "period_end": _date(_found(period, 2), "d MMM yyyy"), "opening_paise": rupees(_found(r"Balance as on .+? : ([\d,]+\.?\d*)"))}


def slice_header() -> dict[str, Column]:
    period = r"Statement Period:\s*(\d{1,2} \w{3} '\d{2})\s*-\s*(\d{1,2} \w{3} '\d{2})"
    balance = lambda name: rupees(_found(rf"{name} balance\s+{RUPEE}([\d,]+\.?\d*)"))
    return {"account_ref": F.concat(F.lit("SLICE_SAV_"), F.right(_found(r"Account Number\s*:\s*(\S+)"), F.lit(4))), "period_start": _spelled_year(_found(period)), "period_end": _spelled_year(_found(period, 2)), "opening_paise": balance("Opening"), "closing_paise": balance("Closing")}


@dataclass(frozen=True)
class Layout:
    """How one kind of statement reads: marks of its text (every one, and one of some), the form its rows come in, header and rows.

    What the header doesn't print of opening and closing comes from the rows' running balances.
    """

    name: str
    account_type: str
    every: tuple[str, ...]
    some: tuple[str, ...]
    unit: str
    rows: Callable[[DataFrame], DataFrame]
    header: Callable[[], dict[str, Column]]

    def fits(self, low: Column) -> Column:
        out, either = F.lit(True), F.lit(not self.some)
        for mark in self.every:
            out &= low.contains(mark)
        for mark in self.some:
            either |= low.contains(mark)
        return out & either


# Marks that tell the layouts apart, in the order in which they are tried.
LAYOUTS = [
    Layout("hdfc_cc", "credit_card", ("hdfc bank", "swiggy"), (), "cells", hdfc_card, card_header),
    Layout("sbi_cc", "credit_card", ("state bank of india", "credit card"), (), "cells", sbi_card, card_header),
    Layout("hdfc_savings", "savings", ("statementfrom", "withdrawalamt"), (), "words", hdfc_savings, hdfc_savings_header),
    Layout("sbi_savings", "savings", ("account statement from",), ("txn date", "balance as on"), "cells", sbi_savings, sbi_savings_header),
    Layout("slice_savings", "savings", ("slice small finance bank",), (), "texts", slice_savings, slice_header),
]
HEADER = ["account_ref", "period_start", "period_end", "opening_paise", "closing_paise"]
KINDS = dict(zip(HEADER, ["string", "date", "date", "bigint", "bigint"]))
NO_LAYOUT, WRONG_ROW, NO_LAST_BALANCE = "no layout fits", "an amount doesn't read", "the last row has no balance"
ABSENT = {"account_ref": "no account", "period_start": "no period", "period_end": "no period", "opening_paise": "no opening balance", "closing_paise": "no closing balance"}


def layout(text: Column, layouts: list[Layout] = LAYOUTS) -> Column:
    """The first layout whose marks the text bears, or null."""
    low, out = F.lower(text), F.lit(None).cast("string")
    for one in reversed(layouts):
        out = F.when(one.fits(low), one.name).otherwise(out)
    return out


def unreadable(texts: DataFrame) -> DataFrame:
    return texts.where(layout(F.col("text")).isNull()).select("statement_id", F.lit(NO_LAYOUT).alias("reason"))


def headers(texts: DataFrame, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """(statement_id, layout, account_type, what the header prints, reason): a field that its layout prints must read."""
    out = _settled(texts, [F.col("statement_id"), F.col("text"), layout(F.col("text"), layouts).alias("layout")])
    picked = {h: F.lit(None).cast(KINDS[h]) for h in HEADER}
    kind, reason = F.lit(None).cast("string"), F.when(F.col("layout").isNull(), NO_LAYOUT)
    for one in layouts:
        mine = F.col("layout") == one.name
        kind = F.when(mine, one.account_type).otherwise(kind)
        for name, value in one.header().items():
            picked[name] = F.when(mine, value).otherwise(picked[name])
    out = _settled(out, [F.col("statement_id"), F.col("layout"), kind.alias("account_type"), *[picked[h].alias(h) for h in HEADER]])
    for one in layouts:
        for name in one.header():
            reason = reason.when((F.col("layout") == one.name) & F.col(name).isNull(), ABSENT[name])
    return _settled(out, [*map(F.col, out.columns), reason.alias("reason")])


ROW = ["statement_id", "pos", "value_date", "narration", "amount_paise", "running_balance_paise"]


def read(texts: DataFrame, cells: DataFrame, words: DataFrame, layouts: list[Layout] = LAYOUTS) -> tuple[DataFrame, DataFrame]:
    """Headers and rows of all statements, each by its own layout.

    Headers gain confidence, row_count, net_paise and balance_check; rows of statements without a reason gain their
    account and identity. Rows meet their header by statement_id, once. Headers as printed and rows as found are
    written to a shared folder, since every layout and both results use them: no text is searched twice.
    """
    heads, units = folders.kept(headers(texts, layouts), "headers"), {"texts": texts, "cells": cells, "words": words}
    plain, found = heads.where("reason IS NULL"), None
    for one in layouts:
        mine = plain.where(F.col("layout") == one.name).select("statement_id")
        rows = one.rows(units[one.unit].join(mine, "statement_id", "left_semi"))
        extra = {"running_balance_paise": F.lit(None).cast("bigint"), "is_wrong": F.lit(False)}
        rows = rows.withColumns({k: v for k, v in extra.items() if k not in rows.columns}).select(*ROW, "is_wrong")
        found = rows if found is None else found.unionByName(rows)
    found = folders.kept(found, "found")
    sums = found.groupBy("statement_id").agg(
        F.count("*").alias("row_count"), F.sum("amount_paise").alias("net_paise"), F.bool_or("is_wrong").alias("is_wrong"),
        F.min_by(F.col("running_balance_paise") - F.col("amount_paise"), "pos").alias("first"), F.max_by(F.struct("running_balance_paise"), "pos").alias("last"),
    )
    inferred = F.col("layout").isin([x.name for x in layouts if "closing_paise" not in x.header()])
    out = heads.join(sums, "statement_id", "left").withColumns({"row_count": F.coalesce("row_count", F.lit(0)), "net_paise": F.coalesce("net_paise", F.lit(0))})
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("is_wrong"), WRONG_ROW).when(inferred & (F.col("row_count") > 0) & F.col("last.running_balance_paise").isNull(), NO_LAST_BALANCE)
    out = _settled(out, [*[F.col(c) for c in out.columns if c not in ("reason", "opening_paise", "closing_paise")], reason.alias("reason"), *[v.alias(k) for k, v in {"opening_paise": F.when(inferred, F.coalesce("opening_paise", "first")).otherwise(F.col("opening_paise")), "closing_paise": F.when(inferred, F.col("last.running_balance_paise")).otherwise(F.col("closing_paise"))}.items()]])
    fine = F.col("reason").isNull()
    out = out.select("statement_id", "layout", "account_type", *[F.when(fine, F.col(h)).alias(h) for h in HEADER], F.when(fine, CONFIDENCE).alias("confidence"), *[F.when(fine, F.col(c)).alias(c) for c in ("row_count", "net_paise")], F.when(fine, balance_check(*map(F.col, ["opening_paise", "closing_paise", "net_paise", "row_count"]))).alias("balance_check"), "reason")
    rows = found.drop("is_wrong").join(out.where("reason IS NULL").select("statement_id", "layout", "account_ref"), "statement_id")
    rows = with_occurrence(rows.withColumn("canonical_narration", canonical(F.col("narration"))), ["statement_id", "value_date", "amount_paise", "canonical_narration"], "pos")
    return out, rows.withColumn("idempotency_hash", identity_hash(*map(F.col, ["account_ref", "value_date", "amount_paise", "canonical_narration", "occurrence_index"])))


def slice_headers(texts: DataFrame) -> DataFrame:
    """Period and balances of each statement of the one layout, and what is wrong where they are missing."""
    out = texts.select("statement_id", *[v.alias(k) for k, v in slice_header().items()])
    return out.withColumn("reason", F.when(F.col("period_start").isNull() | F.col("period_end").isNull(), "no period").when(F.col("opening_paise").isNull() | F.col("closing_paise").isNull(), "no balances"))
