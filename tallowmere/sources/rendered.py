"""Bank rows printed as the five layouts print them: texts, table cells and placed words, faults among them, whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallowmere.sources.views import statements

#: Added to the balances of savings, which print no sign.
ABOVE_ZERO = 10_000_000_000
ROWS_A_PAGE = 40


def _money(paise: Column) -> Column:
    return F.format_number(paise.cast("decimal(20,0)") / 100, 2)


def _signed(paise: Column) -> Column:
    return F.concat(_money(F.abs(paise)), F.when(paise >= 0, F.lit(" Cr")).otherwise(F.lit(" Dr")))


def _short(paise: Column) -> Column:
    return F.regexp_replace(_money(paise), "0$", "")


def _day(date: str, pattern: str) -> Column:
    return F.date_format(date, pattern)


def printed(txn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statements of a week and their rows."""
    of = heads(txn)
    return of, rows(txn, of)


def heads(txn: DataFrame) -> DataFrame:
    """Statements of a week with what they print. The user picks one of five layouts, the last row the fault."""
    heads = statements(txn).withColumns({"statement_id": F.col("ingestion_event_id"), "l": F.pmod("user_id", F.lit(5)), "fault": F.pmod("seq", F.lit(11))})
    above = F.when(F.col("l") >= 2, F.lit(ABOVE_ZERO)).otherwise(F.lit(0))
    return heads.select("statement_id", "l", "fault", "user_id", "period_start", "period_end", F.concat_ws("_", "account_ref", "user_id").alias("account"), (F.col("opening_paise") + above).alias("opening"), (F.col("closing_paise") + above).alias("closing"), "row_count")


def rows(txn: DataFrame, heads: DataFrame) -> DataFrame:
    """The rows of these statements in order, each with the balance after it."""
    sid = F.concat_ws("/", "account_ref", F.col("user_id").cast("string"), F.date_format(F.trunc("value_date", "week"), "yyyy-MM-dd"))
    rows = txn.select(sid.alias("statement_id"), "seq", "value_date", "amount_paise", "narration").join(heads.select("statement_id", "l", "fault", "opening", "row_count"), "statement_id")
    order = W.partitionBy("statement_id").orderBy("seq")
    return rows.withColumns({"n": F.row_number().over(order), "balance": F.col("opening") + F.sum("amount_paise").over(order.rowsBetween(W.unboundedPreceding, 0))})


def texts(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """The text of every statement; that of one layout holds its rows too."""
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\n"))
    unless = lambda fault, text: F.when(F.col("fault") != fault, text).otherwise(F.lit(""))
    marked = lambda text: F.when(F.col("fault") != 5, F.lit(text)).otherwise(F.lit("Another bank\n"))
    opening, closing, account = F.col("opening"), F.col("closing"), F.col("account")
    card = F.concat(line("Account: ", account), unless(0, line("Statement Period: ", _day("period_start", "dd/MM/yyyy"), " to ", _day("period_end", "dd/MM/yyyy"))), unless(1, line("Previous Balance: ", _signed(opening))), unless(2, line("New Balance: ", _signed(closing))))
    word = F.when(F.col("amount_paise") > 0, " Credit").otherwise(" Debit")
    spoken = F.concat(_day("value_date", "dd MMM ''yy"), F.lit("  "), F.col("narration"), word, F.lit(" REF"), F.col("seq").cast("string"), F.lit(" Rs."), _short(F.abs("amount_paise")), F.lit(" ₹"), _short(F.col("balance")), F.lit("\n"))
    lines = rows.where("l = 4").groupBy("statement_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", spoken.alias("line")))).getField("line"), "").alias("lines"))
    number = F.lpad((F.col("user_id") * 10 + F.when(F.col("account").startswith("SAV"), 1).when(F.col("account").startswith("CARD"), 2).otherwise(3)).cast("string"), 12, "0")
    slice_ = F.concat(marked("Slice Small Finance Bank\n"), unless(6, line("Account Number : ", number)), unless(0, line("Statement Period: ", _day("period_start", "dd MMM ''yy"), " - ", _day("period_end", "dd MMM ''yy"))), unless(1, line("Opening balance Rs.", _short(opening))), F.coalesce("lines", F.lit("")), unless(2, line("Closing balance ₹", _short(closing))))
    hdfc = F.concat(line("AccountNo : ", account), unless(0, line("StatementFrom : ", _day("period_start", "dd/MM/yyyy"), " To : ", _day("period_end", "dd/MM/yyyy"))), F.when(F.col("fault") != 5, F.lit("Date Narration WithdrawalAmt. DepositAmt. ClosingBalance\n")).otherwise(F.lit("")), F.when(F.col("fault") == 0, F.lit("StatementFrom\n")).otherwise(F.lit("")))
    sbi = F.concat(line("Account Number : ", account), F.when(F.col("fault") != 0, line("Account Statement from ", _day("period_start", "d MMM yyyy"), " to ", _day("period_end", "d MMM yyyy"))).otherwise(F.lit("Account statement from\n")), unless(1, line("Balance as on ", _day("period_start", "d MMM yyyy"), " : ", _money(opening))), F.when(F.col("fault") != 5, F.lit("Txn Date Value Date Description\n")).otherwise(F.lit("")))
    l, both = F.col("l"), heads.join(lines, "statement_id", "left")
    # A statement of that layout without a mark still bears the other, so its mark is broken in both places.
    sbi = F.when(F.col("fault") == 5, F.regexp_replace(sbi, "Account Statement from|Balance as on", "Of")).otherwise(sbi)
    text = F.when(l == 0, F.concat(marked("HDFC Bank\nSwiggy Card\n"), card)).when(l == 1, F.concat(marked("State Bank of India\nCredit Card Statement\n"), card)).when(l == 2, hdfc).when(l == 3, sbi).otherwise(slice_)
    return both.select("statement_id", text.alias("text"))


def cells(rows: DataFrame) -> DataFrame:
    """The table rows of three layouts, each statement with a heading and a sum that are no transactions."""
    amount, debit, credit = F.col("amount_paise"), F.lit(""), F.lit("")
    day, shown = _day("value_date", "dd/MM/yyyy"), F.col("narration")
    hdfc = F.array(F.concat(day, F.lit(" 10:15:00")), F.when(F.col("seq") % 4 == 0, shown).otherwise(F.lit("UPI")), F.when(F.col("seq") % 4 == 0, F.lit(" ")).otherwise(shown), _signed(amount), F.lit("5"))
    sbi_card = F.array(day, shown, _signed(amount))
    broken = F.when((F.col("fault") == 4) & (F.col("n") == 1), F.lit("12x.00"))
    paid = F.coalesce(broken, _money(F.abs(amount)))
    spelled, last = _day("value_date", "d MMM\nyyyy"), (F.col("fault") == 3) & (F.col("n") == F.col("row_count"))
    sbi = F.array(spelled, spelled, shown, F.lit("REF1"), F.when(amount < 0, paid).otherwise(debit), F.when(amount > 0, paid).otherwise(credit), F.when(last, F.lit("")).otherwise(_money(F.col("balance"))))
    l = F.col("l")
    body = rows.where("l IN (0, 1, 3)").select("statement_id", F.call_function("div", F.col("n"), F.lit(ROWS_A_PAGE)).cast("int").alias("page"), F.col("n").alias("row_pos"), F.when(l == 0, hdfc).when(l == 1, sbi_card).otherwise(sbi).alias("cells"))
    ends = rows.where("l IN (0, 1, 3) AND n = 1")
    heading = F.when(l == 0, F.array(*map(F.lit, ["DATE & TIME", "TRANSACTION", "DESCRIPTION", "AMOUNT", "PI"]))).when(l == 1, F.array(*map(F.lit, ["Date", "Details", "Amount"]))).otherwise(F.array(*map(F.lit, ["Txn Date", "Value Date", "Description", "Ref", "Debit", "Credit", "Balance"])))
    top = ends.select("statement_id", F.lit(0).alias("page"), F.lit(0).alias("row_pos"), heading.alias("cells"))
    total = ends.select("statement_id", F.lit(1 << 20).alias("page"), F.lit(0).alias("row_pos"), F.array(*map(F.lit, ["", "", "Total", "", "1.00", "2.00", "3.00"])).alias("cells"))
    return body.unionByName(top).unionByName(total)


def words(rows: DataFrame) -> DataFrame:
    """The words of one layout, by place. Every second page has no headings."""
    mine = rows.where("l = 2").withColumns({"page": F.call_function("div", F.col("n"), F.lit(ROWS_A_PAGE)).cast("int"), "top": 100.2 + 12.0 * (F.col("n") % ROWS_A_PAGE)})
    word = lambda x, text: F.struct(F.lit(x).alias("x0") if isinstance(x, float) else x.alias("x0"), text.alias("text"))
    spoken = F.transform(F.split(F.trim(F.regexp_replace("narration", " +", " ")), " "), lambda t, k: F.struct((F.lit(80.0) + k * 50.0).alias("x0"), t.alias("text")))
    day = _day("value_date", "dd/MM/yy")
    fixed = F.array(word(30.0, day), word(300.0, F.concat(F.lit("REF"), F.col("seq").cast("string"))), word(340.0, day), word(F.when(F.col("amount_paise") < 0, 380.0).otherwise(450.0), _money(F.abs("amount_paise"))), word(530.0, _money(F.col("balance"))))
    out = mine.select("statement_id", "page", "top", F.explode(F.concat(fixed, spoken)).alias("w"))
    heads = F.array(*[F.struct(F.lit(x).alias("x0"), F.lit(t).alias("text")) for x, t in ((30.0, "Date"), (370.0, "WithdrawalAmt."), (440.0, "DepositAmt."), (520.0, "ClosingBalance"))])
    top = mine.where(f"n % {ROWS_A_PAGE} = 1 AND page % 2 = 0").select("statement_id", "page", F.lit(80.0).alias("top"), F.explode(heads).alias("w"))
    return out.unionByName(top).select("statement_id", "page", "top", "w.x0", "w.text")
