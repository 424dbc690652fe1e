"""Column functions over narrations, money and dates. Money is signed integer paise throughout."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _canonical_any(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t).strip()).upper())


def canonical_ascii(text: Column) -> Column:
    """Trimmed, white space collapsed, upper case: what `canonical` gives for ASCII."""
    return F.upper(F.trim(F.regexp_replace(text, r"[\x09-\x0D\x1C-\x20]+", " ")))


def canonical(text: Column) -> Column:
    """NFKC, trimmed, white space collapsed, upper case. Only texts beyond ASCII pass through Python."""
    plain = ~text.rlike(r"[^\x00-\x7F]")
    return F.when(text.isNull() | plain, canonical_ascii(text)).otherwise(_canonical_any(F.when(~plain, text)))


def identity_hash(account: Column, date: Column, amount: Column, narration: Column, occurrence: Column) -> Column:
    """SHA-256 of `account|date|amount|narration|occurrence`; null where any part is (concat_ws would drop it)."""
    parts = [account, F.date_format(date, "yyyy-MM-dd"), amount.cast("string"), narration, occurrence.cast("string")]
    whole = F.lit(True)
    for p in parts:
        whole &= p.isNotNull()
    return F.when(whole, F.sha2(F.concat_ws("|", *parts), 256))


def rupees(text: Column) -> Column:
    """`1,234.56` as paise, cut off below one paisa; null if it isn't a number."""
    return (F.regexp_replace(F.trim(text), ",", "").try_cast("decimal(24,6)") * 100).cast("bigint")


def rupees_cr_dr(text: Column) -> Column:
    """`1,234.56 Cr` as paise: negative for any mark but Cr, positive without a mark."""
    amount = rupees(F.regexp_extract(F.trim(text), r"^(\S+)", 1))
    mark = F.upper(F.regexp_extract(F.trim(text), r"\s(\S+)$", 1))
    return F.when(mark.isin("", "CR"), amount).otherwise(-amount)


def round_to(paise: Column, unit: int = 10) -> Column:
    """To the nearest multiple of `unit`, halves up."""
    rest = F.pmod(paise, F.lit(unit))
    return paise - rest + F.when(rest * 2 >= unit, F.lit(unit)).otherwise(F.lit(0))


def floor_div(a: Column, b: Column) -> Column:
    """a over b, rounded down, b positive; exact on integers."""
    return F.call_function("div", a - F.pmod(a, b), b)


def basis_points(part: Column, whole: Column) -> Column:
    """Ten-thousandths that `part` is of a positive `whole`, rounded down; exact, as no quotient is rounded before."""
    return floor_div(part.cast("decimal(30,0)") * 10000, whole.cast("decimal(20,0)"))


def india_time(utc: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), utc)


def fiscal_year(date: Column) -> Column:
    """April to March, named by the year it starts in."""
    return F.year(date) - F.when(F.month(date) < 4, 1).otherwise(0)


def fiscal_quarter(date: Column) -> Column:
    return (F.floor(F.pmod(F.month(date) - 4, F.lit(12)) / 3) + 1).cast("int")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether closed ranges meet; a missing bound means no."""
    return F.coalesce((a_start <= b_end) & (b_start <= a_end), F.lit(False))


def indian_grouping(paise: Column) -> Column:
    """`−₹12,34,567.89`: the last three digits, then pairs."""
    whole = F.call_function("abs", paise)
    digits = (whole - F.pmod(whole, F.lit(100))).cast("decimal(20,0)") / 100
    text = F.regexp_replace(digits.cast("decimal(20,0)").cast("string"), r"(?<=\d)(?=(\d\d)*\d{3}$)", ",")
    return F.concat(F.when(paise < 0, F.lit("−")).otherwise(F.lit("")), F.lit("₹"), text, F.lit("."), F.lpad(F.pmod(whole, F.lit(100)).cast("string"), 2, "0"))


def content_hash(content: Column) -> Column:
    """SHA-256 of a file's bytes or a text's UTF-8, in lower-case hex."""
    return F.sha2(content, 256)


def money_text(paise: Column) -> Column:
    """Paise for JSON, as text: readers that know only doubles would round numbers past 2^53."""
    return paise.cast("string")


def money_of_text(text: Column) -> Column:
    """Back from `money_text`; null if the text isn't a whole number."""
    return F.when(F.trim(text).rlike(r"\A[+-]?[0-9]+\z"), F.trim(text).try_cast("bigint"))
