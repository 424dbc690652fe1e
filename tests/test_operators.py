"""Edge cases of the ledger's operators."""

import datetime as dt
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tallowmere.functions import columns as c
from tallowmere.operators import balances, budgets, classify, identity, resolve, series
from tallowmere.sources import log, statements

DAY = dt.date(2026, 3, 1)


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'date' if isinstance(v, dt.date) else 'bigint'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("text", ["  a  b\tC ", "ﬁne ß", "Ⅷ½ ", "", "é", " x　y"])
def test_canonical(spark, text):
    assert one(spark, c.canonical(F.col("t")), t=text) == " ".join(unicodedata.normalize("NFKC", text).split()).upper()


@pytest.mark.parametrize("text,paise", [("1,234.56 Cr", 123456), ("1,234.56 Dr", -123456), ("12.5", 1250), ("0.019 dr", -1), ("x Cr", None)])
def test_card_amount(spark, text, paise):
    assert one(spark, c.rupees_cr_dr(F.col("t")), t=text) == paise


@pytest.mark.parametrize("paise,rounded", [(104, 100), (105, 110), (-104, -100), (-105, -100), (-106, -110), (0, 0)])
def test_round(spark, paise, rounded):
    assert one(spark, c.round_to(F.col("p")), p=paise) == rounded


@pytest.mark.parametrize("part,whole,bps", [(3000, 30000001, 0), (30000001, 30000001, 10000), (-1, 30000001, -1), (0, 7, 0)])
def test_basis_points_just_below_a_whole_number(spark, part, whole, bps):
    assert one(spark, c.basis_points(F.col("p"), F.col("w")), p=part, w=whole) == bps


def test_share_just_below_a_whole_number(spark):
    rows = spark.createDataFrame([(1, DAY, -3000, "food_dining", "A"), (1, DAY, -29997001, "rent_housing", "B")], "user_id long, value_date date, amount_paise long, category string, merchant string")
    split = series.series(rows, "merchant").where("series = 'category_split' AND grain = 'month'")
    assert {r.key: r.value for r in split.collect()} == {"food_dining": 0, "rent_housing": 9999}


def test_calendar(spark):
    rows = spark.sql("SELECT explode(array(timestamp_ntz'2026-03-31 23:30:00', timestamp_ntz'2026-03-31 00:00:00')) AS ts")
    assert [r.x for r in rows.select(c.fiscal_year(c.india_time(F.col("ts"))).alias("x")).collect()] == [2026, 2025]


def test_rupee_grouping(spark):
    assert one(spark, c.indian_grouping(F.col("p")), p=-123456789) == "−₹12,34,567.89"
    assert one(spark, c.indian_grouping(F.col("p")), p=5) == "₹0.05"


def test_hash_is_null_for_missing_parts(spark):
    rows = spark.createDataFrame([("A", DAY, 1, "N", 0), ("A", None, 1, "N", 0)], "a string, d date, m bigint, n string, o int")
    a, b = [r.x for r in rows.select(c.identity_hash(*map(F.col, "admno"[0:1] + "dmno")).alias("x")).collect()]
    assert len(a) == 64 and b is None


def test_split_is_exact(spark):
    rows = spark.createDataFrame([(1, 0, -7, 1), (1, 1, -7, 1), (1, 2, -7, 0), (2, 0, 100, 1), (2, 1, 100, 1), (2, 2, 100, 1)], "k bigint, i bigint, total bigint, weight bigint")
    out = log.split_by_weight(rows, "k", ["i"]).orderBy("k", "i").collect()
    assert [r.share_paise for r in out] == [-3, -4, 0, 34, 33, 33]


def candidates(spark, rows):
    return spark.createDataFrame([(1, s, t, a, DAY + dt.timedelta(d)) for s, t, a, d in rows], "user_id bigint, seq bigint, account_type string, amount_paise bigint, value_date date")


@pytest.mark.parametrize("gap,confidence", [(0, 9500), (1, 8800), (2, 8600), (3, None), (4, None)])
def test_gap(spark, gap, confidence):
    out = resolve.resolve(candidates(spark, [(1, "savings", -5, 0), (2, "savings", 5, gap)])).collect()
    assert [r.confidence for r in out] == ([confidence] if confidence else [])


def brute(rows):
    used, out = set(), []
    fits = [lambda d, k: (d, k) == ("savings", "savings"), lambda d, k: (d, k) == ("savings", "credit_card"), lambda d, k: (d, k) == ("savings", "fd"), lambda d, k: d == k]
    for name, fit in zip(["transfer", "credit_card_payment", "fd_booking", "reversal"], fits):
        for s, t, a, d in sorted(rows):
            if a >= 0 or s in used:
                continue
            for s2, t2, a2, d2 in sorted(rows):
                if a2 == -a and s2 not in used and fit(t, t2) and abs(d - d2) <= 2:
                    used |= {s, s2}
                    out.append((s, s2, name))
                    break
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_cascade_against_loops(spark, seed):
    r = random.Random(seed)
    rows = [(s, r.choice(["savings", "credit_card", "fd"]), r.choice([-1, 1]) * r.randint(0, 3), r.randint(0, 12)) for s in range(150)]
    out = resolve.resolve(candidates(spark, rows)).collect()
    assert sorted((x.debit_seq, x.credit_seq, x.matched_by) for x in out) == brute(rows)


def test_cascade_over_batches_nulls_and_repeats(spark):
    r = random.Random(7)
    rows = [(s, r.choice(["savings", "credit_card", "fd"]), r.choice([-1, 1]) * r.randint(1, 2), r.randint(0, 60)) for s in range(200)]
    more = [(1000, None, 1, 3), (1001, "savings", 0, 3), *rows[:20]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        out = resolve.resolve(candidates(spark, rows + more)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((x.debit_seq, x.credit_seq, x.matched_by) for x in out) == brute(rows)
    assert resolve.resolve(candidates(spark, rows).limit(0)).count() == 0


def test_one_amount_every_day():
    """An island without an end: twice the rows take about twice the steps."""
    n = 100_000
    legs = [(s, "savings", s // 2) for s in range(n)]
    assert len(list(resolve.paired(legs[::2], legs[1::2], resolve.MATCHERS))) == n // 2


@pytest.mark.parametrize("opening,closing,net,n,verdict", [(0, 0, None, 0, "pass"), (0, 1, None, 0, "fail"), (None, 1, 1, 1, "fail"), (None, None, None, 0, "not_applicable"), (100, 150, 50, 2, "pass"), (100, 151, 50, 2, "fail")])
def test_balance_check(spark, opening, closing, net, n, verdict):
    row = spark.createDataFrame([(opening, closing, net, n)], "o bigint, c bigint, t bigint, n bigint")
    assert row.select(identity.balance_check(*map(F.col, "octn")).alias("x")).first().x == verdict


def test_balance_follows_provenance(spark):
    periods = spark.createDataFrame([("s1", 1, "A", DAY, DAY + dt.timedelta(6), "ingested", "pass", 1000, 1), ("s2", 1, "A", DAY, DAY + dt.timedelta(13), "ingested", "fail", 9, 2), ("s3", 1, "B", DAY, DAY, "ingested", "fail", 9, 3)], "ingestion_event_id string, user_id bigint, account_ref string, period_start date, period_end date, status string, balance_check string, closing_paise bigint, seq bigint")
    legs = spark.createDataFrame([(1, "A", 1, 5, "s1"), (1, "A", 2, 7, "s2"), (1, "A", 3, 11, "lost"), (1, "B", 4, 1, "s3")], "user_id bigint, account_ref string, seq bigint, amount_paise bigint, ingestion_event_id string")
    out = {r.account_ref: (r.balance_paise, r.is_stale) for r in balances.balances(legs, periods).collect()}
    assert out == {"A": (1007, True), "B": (None, False)}


def test_budget_refunds_and_corruption(spark):
    rows = spark.createDataFrame([(1, 1, DAY, -100, "rent_housing"), (1, 2, DAY, 300, "rent_housing"), (1, 3, DAY, 900, "income")], "user_id bigint, seq bigint, value_date date, amount_paise bigint, category string")
    spend = budgets.net_spend(rows)
    assert [(r.category, r.spent_paise) for r in spend.collect()] == [("rent_housing", -200)]
    limits = spark.createDataFrame([(1, "rent_housing", DAY, 0), (1, "travel", DAY, 50)], "user_id bigint, category string, month date, target_paise bigint")
    assert {(r.category, r.remaining_paise, r.used_bps) for r in budgets.utilisation(limits, spend).collect()} == {("rent_housing", 200, 0), ("travel", 50, 0)}
    same = rows.withColumn("h", F.lit("x"))
    with pytest.raises(Exception, match="differ"):
        budgets.checked_once(same, "h").collect()
    assert budgets.checked_once(rows.limit(1).union(rows.limit(1)).withColumn("h", F.lit("x")), "h").count() == 1


def test_correction_beats_later_decision(spark):
    s = "user_id bigint, txn bigint, category string, seq bigint"
    decided = spark.createDataFrame([(1, 1, "travel", 9), (1, 2, "other", 1)], s)
    corrected = spark.createDataFrame([(1, 1, "rent_housing", 2), (1, 1, "insurance", 3)], s)
    assert {(r.txn, r.category) for r in classify.effective_category(decided, corrected).collect()} == {(1, "insurance"), (2, "other")}


def test_model_answers_below_threshold_stay_open(spark):
    rows = spark.createDataFrame([("a", None), ("b", "other")], "narration string, category string")
    for sure, first in ((8000, "food_dining"), (7000, None)):
        out = {r.narration: r.category for r in classify.with_model(rows, classify.stub_model("food_dining", sure), "narration", "category").collect()}
        assert out == {"a": first, "b": "other"}


def test_layouts(spark):
    texts = spark.createDataFrame([("1", "HDFC Bank Swiggy card"), ("2", "Account Statement from 1 to 2\nTxn Date"), ("3", "letter")], "statement_id string, text string")
    assert [r.x for r in texts.orderBy("statement_id").select(statements.layout(F.col("text")).alias("x")).collect()] == ["hdfc_cc", "sbi_savings", None]
    assert [r.statement_id for r in statements.unreadable(texts).collect()] == ["3"]


def test_card_cells(spark):
    cells = spark.createDataFrame([("1", 1, 0, ["DATE", "T", "D", "AMOUNT", "PI"]), ("1", 1, 1, ["01/05/2026 10:00:00", "UPI", "", "1,200.50 Dr", ""]), ("1", 1, 2, ["02/05/2026", "X", "Refund  shop", "10.00 Cr", ""])], "statement_id string, page int, row_pos int, cells array<string>")
    assert [(r.narration, r.amount_paise, r.pos) for r in statements.hdfc_card(cells).orderBy("pos").collect()] == [("UPI", -120050, 0), ("Refund shop", 1000, 1)]


def test_savings_cells(spark):
    cells = spark.createDataFrame([("1", 1, 1, ["1 May 2026", "1 May\n2026", "NEFT  in", "r", "", "500.00", "1,500.00"]), ("1", 1, 2, ["2 May 2026", "2 May 2026", "ATM", "r", "20.00", "", "1,480.00"])], "statement_id string, page int, row_pos int, cells array<string>")
    assert [(r.amount_paise, r.running_balance_paise) for r in statements.sbi_savings(cells).orderBy("pos").collect()] == [(50000, 150000), (-2000, 148000)]


def test_savings_words(spark):
    row = lambda top, *ws: [("1", 1, top, float(x), t) for x, t in ws]
    words = row(10.0, (40, "Date"), (300, "WithdrawalAmt."), (400, "DepositAmt."), (500, "ClosingBalance")) + row(20.2, (40, "01/05/26"), (90, "UPI"), (120, "SHOP"), (200, "REF001"), (250, "02/05/26"), (310, "1,000.00"), (505, "9,000.00")) + row(30.1, (40, "03/05/26"), (90, "PAY"), (250, "03/05/26"), (410, "5.00"), (505, "9,005.00")) + row(40.0, (40, "04/05/26"), (90, "NOBALANCE"), (410, "5.00"))
    out = statements.hdfc_savings(spark.createDataFrame(words, "statement_id string, page int, top double, x0 double, text string")).orderBy("pos").collect()
    assert [(r.value_date, r.narration, r.amount_paise, r.running_balance_paise) for r in out] == [(dt.date(2026, 5, 2), "UPI SHOP", -100000, 900000), (dt.date(2026, 5, 3), "PAY", 500, 900500)]


def test_slice_text(spark):
    text = "slice small finance bank\nAccount Number : 00112233\nStatement Period: 01 May '26 - 31 May '26\nOpening balance Rs.100.5\nClosing balance ₹80\n05 May '26 UPI Debit shop 123 Rs.20.5 Rs.80\n06 May '26 nothing 9 Rs.1 Rs.2"
    df = spark.createDataFrame([("1", text)], "statement_id string, text string")
    r = statements.slice_savings(df).collect()
    assert [(x.account_ref, x.value_date, x.amount_paise, x.running_balance_paise) for x in r] == [("SLICE_SAV_2233", dt.date(2026, 5, 5), -2050, 8000)]
    h = statements.slice_headers(df).first()
    assert (h.opening_paise, h.closing_paise, h.period_end, h.reason) == (10050, 8000, dt.date(2026, 5, 31), None)


def test_appending_known_rows(spark):
    known = spark.createDataFrame([(1, "h1")], "user_id bigint, idempotency_hash string")
    rows = spark.createDataFrame([(1, "h1", "s"), (1, "h2", "s"), (1, "h3", "t")], "user_id bigint, idempotency_hash string, ingestion_event_id string")
    assert {r.idempotency_hash for r in identity.new_rows(rows, known).collect()} == {"h2", "h3"}
    assert {r.idempotency_hash for r in identity.new_rows(rows, known, strict=True).collect()} == {"h3"}


def test_stream_decides_once(spark, tmp_path):
    from tallowmere.streaming.resolver import start

    schema = "user_id bigint, seq bigint, account_type string, amount_paise bigint, value_date date"
    source = str(tmp_path / "in")
    run = lambda: start(spark.readStream.schema(schema).parquet(source), *[str(tmp_path / x) for x in ("log", "decisions", "check")]).awaitTermination()
    candidates(spark, [(1, "savings", -5, 0), (2, "fd", 5, 0)]).write.parquet(source)
    run()
    candidates(spark, [(3, "savings", 5, 0), (4, "savings", -5, 1)]).write.mode("append").parquet(source)
    run()
    out = spark.read.parquet(str(tmp_path / "decisions")).collect()
    assert {(r.debit_seq, r.credit_seq) for r in out} == {(1, 2), (4, 3)}
