"""All ledger queries: each runs over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallowmere.functions import columns as c
from tallowmere.operators import balances, budgets, classify, entities, identity, ledger, resolve, series
from tallowmere.plans.oracles import ORACLE
from tallowmere.schema import CATEGORIES, EXPENSE
from tallowmere.sources import commits, folders, folds, intake, log, rendered, snapshots, staging, statements, views
from tallowmere.streaming import keyed

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _txn(spark, d):
    return views.ledger_txn(spark, d)


@query
def canonical_narration_ascii(spark: SparkSession, d: str) -> DataFrame:
    return identity.with_canonical(_txn(spark, d)).select("user_id", "seq", "canonical_narration")


@query
def occurrence_index(spark, d):
    return identity.with_identity(_txn(spark, d)).select("user_id", "seq", "occurrence_index")


@query
def idempotency_hash(spark, d):
    return identity.with_identity(_txn(spark, d)).select("user_id", "seq", "idempotency_hash")


def _printed(spark, d):
    """Amounts of `orders` as statements print them."""
    paise = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.format_number(paise.cast("decimal(20,0)") / 100, 2).alias("printed"))


@query
def amount_parse_cr_dr(spark, d):
    mark = F.element_at(F.array(*map(F.lit, ["", " Dr", " Cr"])), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int"))
    return _printed(spark, d).select("o_orderkey", c.rupees_cr_dr(F.concat("printed", mark)).alias("amount_paise"))


@query
def amount_parse_plain(spark, d):
    return _printed(spark, d).select("o_orderkey", c.rupees(F.col("printed")).alias("amount_paise"))


@query
def fiscal_year_quarter(spark, d):
    local = c.india_time(F.col("ts"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", c.fiscal_year(local).cast("int").alias("fiscal_year"), c.fiscal_quarter(local).alias("fiscal_quarter"))


@query
def month_buckets(spark, d):
    return views.ledger_long(spark, d).groupBy("user_id", budgets.month()).agg(F.count("*").alias("n"), F.sum("amount_paise").alias("net_paise"))


@query
def largest_remainder_split(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("total"))
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("weight")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return log.split_by_weight(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "weight"]).select("l_orderkey", "l_linenumber", "share_paise")


@query
def round_nearest_10(spark, d):
    return views.ledger_long(spark, d).select("seq", c.round_to(F.col("amount_paise")).alias("rounded_paise"))


@query
def balance_check(spark, d):
    s = views.statements(_txn(spark, d))
    return s.select("ingestion_event_id", identity.balance_check(F.col("opening_paise"), F.col("closing_paise"), F.col("net"), F.col("row_count")).alias("balance_check"))


def _rows_of_statements(spark, d):
    """Every row with its week's statement, by the derived id, and the statement's opening."""
    txn = _txn(spark, d)
    sid = F.concat_ws("/", "account_ref", F.col("user_id").cast("string"), F.date_format(F.trunc("value_date", "week"), "yyyy-MM-dd"))
    opening = views.statements(txn).select("ingestion_event_id", "opening_paise")
    rows = txn.withColumn("ingestion_event_id", sid).join(opening, "ingestion_event_id")
    return identity.with_running_balance(rows, ["ingestion_event_id"], "opening_paise")


@query
def opening_closing_inference(spark, d):
    return identity.infer_balances(_rows_of_statements(spark, d).drop("opening_paise"), ["ingestion_event_id"])


@query
def running_balance_check(spark, d):
    return _rows_of_statements(spark, d).select("user_id", "seq", "running_balance_paise")


def _matcher(n: int):
    return lambda spark, d: resolve.resolve(_txn(spark, d), resolve.MATCHERS[n : n + 1])


QUERIES |= {f"resolver_{name}": _matcher(n) for n, name in enumerate(["transfer", "cc", "fd", "reversal"])}


@query
def resolver_cascade(spark, d):
    return resolve.resolve(_txn(spark, d))


@query
def resolver_decision_hash(spark, d):
    rows = identity.with_identity(_txn(spark, d))
    return resolve.decisions(resolve.resolve(rows), rows).select("user_id", "debit_seq", "credit_seq", "decision_hash")


@query
def resolver_incremental(spark, d):
    """The second half of the rows resolved on top of the first half's decisions."""
    txn = _txn(spark, d)
    half = txn.agg(F.expr("(min(seq) + max(seq)) div 2")).first()[0]
    first = resolve.resolve(txn.where(F.col("seq") <= half))
    return first.unionByName(resolve.resolve_new(txn, first, half))


def _view(spark, d):
    txn = _txn(spark, d)
    return ledger.transactions_view(txn, resolve.exclusions(resolve.resolve(txn)))


@query
def transactions_view(spark, d):
    return _view(spark, d).select("user_id", "seq", "account_ref", "amount_paise", "value_date", "is_counted")


@query
def transactions_view_totals_literal(spark, d):
    """Totals by the types income and expense, which ingested rows (debit, credit) never have."""
    typed = _view(spark, d).withColumn("transaction_type", F.when(F.col("amount_paise") < 0, "debit").otherwise("credit"))
    return ledger.totals(typed, "transaction_type = 'income'", "transaction_type = 'expense'")


@query
def transactions_view_totals_derived(spark, d):
    return ledger.totals(_view(spark, d), "amount_paise > 0", "amount_paise < 0")


@query
def exclusion_reasons(spark, d):
    return resolve.exclusions(resolve.resolve(_txn(spark, d)))


@query
def dedup_ledger(spark, d):
    view = _view(spark, d)
    covered = ledger.covering(view, views.statement_periods(_txn(spark, d)))
    return view.join(covered, ["user_id", "seq"]).select("user_id", "seq", "is_counted", "reason", "covering_count")


@query
def dedup_ledger_range(spark, d):
    rows = _view(spark, d).where("value_date IS NULL OR value_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("is_counted").alias("counted"), F.count_if(~F.col("is_counted")).alias("excluded"))


@query
def covering_statements(spark, d):
    txn = _txn(spark, d)
    return ledger.covering(txn, views.statement_periods(txn))


@query
def overlap_map(spark, d):
    return ledger.overlap_map(views.statement_periods(_txn(spark, d)))


@query
def sync_history(spark, d):
    return ledger.sync_history(views.statement_periods(_txn(spark, d)), "2024-02-20")


@query
def resolver_pairings(spark, d):
    txn = _txn(spark, d)
    return ledger.pairings(resolve.resolve(txn), txn)


@query
def account_transactions(spark, d):
    rows = _txn(spark, d).where(F.col("value_date").between("2024-01-05", "2024-01-25"))
    return rows.select("user_id", "account_ref", "seq", "value_date", "amount_paise").orderBy(F.desc("value_date"), F.desc("seq"))


def _balances(spark, d):
    txn = _txn(spark, d)
    sid = F.concat_ws("/", "account_ref", F.col("user_id").cast("string"), F.date_format(F.trunc("value_date", "week"), "yyyy-MM-dd"))
    lost = (F.col("user_id") % 29 == 0) & (F.col("seq") % 7 == 0)
    return balances.balances(txn.withColumn("ingestion_event_id", F.concat(sid, F.when(lost, "?").otherwise(""))), views.statement_periods(txn))


@query
def anchor_selection(spark, d):
    return balances.anchors(views.statement_periods(_txn(spark, d)))


@query
def account_balance(spark, d):
    return _balances(spark, d).drop("is_stale")


@query
def card_liability(spark, d):
    return balances.liabilities(_balances(spark, d))


@query
def stale_accounts(spark, d):
    return _balances(spark, d).where("is_stale").select("user_id", "account_ref")


@query
def account_type_mismatch(spark, d):
    txn = _txn(spark, d)
    wrong = F.when(F.col("user_id") % 23 == 0, "current").otherwise(F.col("account_type"))
    accounts = txn.select("user_id", "account_ref", wrong.alias("account_type")).distinct()
    return balances.type_mismatches(accounts, views.statement_periods(txn))


def _named(spark, d):
    return classify.with_merchant(_txn(spark, d))


def _corrections(rows):
    names = F.array(*map(F.lit, CATEGORIES))
    return rows.where("seq % 37 = 0").select("user_id", "merchant", F.col("seq").alias("txn"), F.element_at(names, (F.col("seq") % 16 + 1).cast("int")).alias("category"), "seq")


@query
def merchant_normalise(spark, d):
    return _named(spark, d).select("user_id", "seq", "merchant")


@query
def learned_rules(spark, d):
    return classify.learned_rules(_corrections(_named(spark, d)))


@query
def category_classify(spark, d):
    rows = _named(spark, d)
    return classify.with_category(rows, classify.learned_rules(_corrections(rows))).select("user_id", "seq", "category")


@query
def effective_category(spark, d):
    rows = _named(spark, d)
    corrections = _corrections(rows)
    decided = classify.with_category(rows, classify.learned_rules(corrections)).select("user_id", F.col("seq").alias("txn"), "category", "seq")
    return classify.effective_category(decided, corrections)


@query
def nature_tag(spark, d):
    return views.ledger_long(spark, d).where("amount_paise < 0").select("seq", classify.nature(F.col("category")).alias("nature"))


@query
def running_cost_split(spark, d):
    return budgets.running_cost(views.ledger_long(spark, d))


@query
def budget_net_spend(spark, d):
    return budgets.net_spend(views.ledger_long(spark, d))


@query
def budget_projection(spark, d):
    spend = budgets.net_spend(views.ledger_long(spark, d))
    targets = views.ledger_long(spark, d).where(F.col("category").isin(EXPENSE)).select("user_id", "category", budgets.month(), (F.col("user_id") % 5 * 10000000).alias("target_paise")).distinct()
    later = targets.withColumn("month", F.add_months("month", 1))  # some have no spend yet
    return budgets.utilisation(targets.unionByName(later).distinct(), spend)


def _figures(spark, d):
    return budgets.key_figures(views.ledger_long(spark, d), ["user_id", budgets.month()])


@query
def kpi_strip(spark, d):
    return _figures(spark, d).select("user_id", "month", "expense_paise", "income_paise", "refund_paise", "net_paise", "savings_bps")


@query
def kpi_reconciliation(spark, d):
    return _figures(spark, d).groupBy("user_id").agg(F.sum("expense_paise").alias("expense_paise"), F.sum(F.col("categorised_paise") + F.col("uncategorised_paise")).alias("parts_paise"))


@query
def trend_income_expense(spark, d):
    return _figures(spark, d).select("user_id", "month", "income_paise", "expense_paise")


@query
def category_trend(spark, d):
    before = F.lag("spent_paise").over(W.partitionBy("user_id", "category").orderBy("month"))
    return budgets.net_spend(views.ledger_long(spark, d)).withColumn("change", F.col("spent_paise") - before)


@query
def net_cashflow_trend(spark, d):
    return budgets.trend(_figures(spark, d), "net_paise")


@query
def savings_rate_trend(spark, d):
    return budgets.trend(_figures(spark, d), "savings_bps")


@query
def top_merchants(spark, d):
    return budgets.top_by(_named(spark, d), "merchant")


@query
def events_list_counts(spark, d):
    return log.events_list(log.as_events(_txn(spark, d))).select("user_id", "events", "first_seq", "last_seq")


@query
def upcast_chain(spark, d):
    events = log.as_events(_txn(spark, d), old=F.col("seq") % 2 == 0)
    return log.upcast(events).select("user_id", "seq", "event_version", log.field("narration"), log.field("amount_paise", "bigint"))


@query
def payload_roundtrip(spark, d):
    keys = _txn(spark, d).select("user_id").distinct().withColumn("key", F.when(F.col("user_id") % 31 != 0, F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 32)))
    sealed = log.seal(log.as_events(_txn(spark, d)), keys.withColumn("key", F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 32)))
    opened = log.unseal(sealed, keys)
    return opened.select("user_id", "seq", F.col("payload").isNotNull().alias("readable"), log.field("narration"))


@query
def content_hash(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", c.content_hash(F.col("props")).alias("content_hash"))


@query
def money_text(spark, d):
    rows = views.ledger_long(spark, d).withColumn("text", c.money_text(F.col("amount_paise") * 1000003))
    return rows.select("seq", "text", c.money_of_text(F.col("text")).alias("back_paise"))


NOW = "timestamp'2024-02-01 01:30:00'"


def _staged(spark, d):
    """Every statement as an upload of the two hours before, with its rows; some have no check."""
    txn = _txn(spark, d)
    check = F.when(F.col("seq") % 13 != 0, F.col("balance_check")).otherwise("not_applicable")
    created = F.expr("timestamp'2024-02-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, seq * 37 % 7200)")
    p = views.statement_periods(txn)
    sessions = p.select(F.col("ingestion_event_id").alias("session_id"), "user_id", "account_ref", "account_type", "period_start", "period_end", "opening_paise", "closing_paise", check.alias("balance_check"), F.lit(9500).alias("confidence"), F.sha2("ingestion_event_id", 256).alias("content_hash"), created.alias("created_at"), "seq")
    sid = F.concat_ws("/", "account_ref", F.col("user_id").cast("string"), F.date_format(F.trunc("value_date", "week"), "yyyy-MM-dd"))
    ended = sessions.where("seq % 10 = 3").select("session_id")
    return staging.live(staging.with_expiry(sessions), F.expr(NOW), ended), txn.withColumn("session_id", sid)


@query
def upload_preview(spark, d):
    """Sessions that are still there at a time, after others ran out or were abandoned."""
    return staging.preview(*_staged(spark, d)).select("session_id", "user_id", "balance_check", "confidence", "row_count", "net_paise")


@query
def commit_statements(spark, d):
    done = staging.confirm(*_staged(spark, d))
    kept = done["artifacts"].select("ingestion_event_id", "content_hash", "retained")
    return done["statements"].join(kept, "ingestion_event_id").select("ingestion_event_id", "user_id", "status", "records_added", "content_hash", "retained")


@query
def commit_events(spark, d):
    return staging.confirm(*_staged(spark, d))["events"].select("ingestion_event_id", "user_id", "seq", "amount_paise", "transaction_type", "event_type")


@query
def append_order(spark, d):
    """Rows numbered as the log would: each user's in order, after what is there."""
    rows = identity.with_identity(_txn(spark, d)).withColumnRenamed("seq", "source_seq")
    new = log.numbered(rows, 1000, ["source_seq"])
    place = F.row_number().over(W.partitionBy("user_id").orderBy("seq"))
    return new.select("user_id", "source_seq", place.alias("place"), (F.col("seq") > 1000).alias("is_after"))


@query
def account_stream(spark, d):
    events = log.as_events(_txn(spark, d))
    return log.stream(events, "SAV_1", 100).select("user_id", "seq", "aggregate_id", log.field("amount_paise", "bigint")).orderBy("user_id", "seq")


@query
def replay_from_snapshot(spark, d):
    events = log.as_events(_txn(spark, d))
    return log.replay(log.events_list(events.where("seq <= 400")), events, 400).select("user_id", "events", "first_seq", "last_seq")


@query
def candidate_defaults(spark, d):
    """Events, a third of them without an account type, as typed rows."""
    bare = F.regexp_replace("payload", ',"account_type":"[a-z_]+"', "")
    events = log.as_events(_txn(spark, d)).withColumn("payload", F.when(F.col("seq") % 3 == 0, bare).otherwise(F.col("payload")))
    return log.candidates(events).select("user_id", "seq", "account_ref", "account_type", "transaction_type", "amount_paise")


@query
def active_keys(spark, d):
    """Keys of users: an old one, a new one, and one deactivated."""
    e = _txn(spark, d).select("user_id").distinct()
    n = F.explode(F.sequence(F.lit(0), F.pmod("user_id", F.lit(3)).cast("int"))).alias("n")
    keys = e.select("user_id", n).select("user_id", (F.col("user_id") * 10 + F.col("n")).alias("key_id"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("n") * 7).alias("created_at"), F.when(F.pmod(F.col("user_id") + F.col("n"), F.lit(4)) == 1, F.lit("2024-02-01").cast("date")).alias("deactivated_at"))
    return entities.active_keys(keys)


def _account_changes(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("r", F.pmod("o_orderkey", F.lit(7)))
    op = F.when(F.col("r") < 3, "create").when(F.col("r") < 6, "patch").otherwise("deactivate")
    kinds = F.array(*map(F.lit, ["savings", "current", "credit_card", "loan"]))
    return o.select(F.col("o_custkey").alias("account_id"), op.alias("op"), F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 200).alias("user_id"), F.concat(F.lit("SAV_"), F.col("o_orderkey").cast("string")).alias("account_ref"), F.when(F.col("o_orderkey") % 5 > 0, F.substring("o_orderpriority", 3, 128)).alias("nickname"), F.when(F.col("o_orderkey") % 4 > 0, F.element_at(kinds, (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("account_type"), F.when(F.col("o_orderkey") % 3 > 0, F.substring(F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), 3, 4)).alias("last4"))


@query
def accounts_current(spark, d):
    return entities.accounts(_account_changes(spark, d))


@query
def account_requests(spark, d):
    """Which fields of each request to make an account are wrong."""
    made = _account_changes(spark, d).where("op = 'create'")
    last4 = F.when(F.col("seq") % 11 == 0, F.lit("12a4")).otherwise(F.col("last4"))
    return made.select("seq", entities.wrong_account(F.col("nickname"), F.col("account_type"), last4, F.col("account_ref")).alias("wrong"))


def _budget_changes(spark, d):
    rows = views.ledger_long(spark, d).where(F.col("category").isin(EXPENSE))
    r = F.pmod(F.col("seq"), F.lit(5))
    op = F.when(r < 2, "create").when(r < 4, "patch").otherwise("delete")
    month = F.trunc(F.add_months("value_date", -(F.month("value_date") - 1) % 6), "month")
    return rows.select("user_id", "category", month.alias("month"), (F.col("seq") * 100).alias("target_paise"), op.alias("op"), "seq")


@query
def budget_outcomes(spark, d):
    return entities.budget_outcomes(_budget_changes(spark, d)).select("user_id", "category", "month", "seq", "op", "code")


@query
def budgets_current(spark, d):
    return entities.budgets(_budget_changes(spark, d))


@query
def budget_requests(spark, d):
    rows = views.ledger_long(spark, d)
    return rows.select("seq", entities.wrong_budget(F.col("category"), F.col("value_date"), F.col("amount_paise")).alias("wrong"))


@query
def balance_reports(spark, d):
    """Every account's balance or what stands against it: types unset or unfit, payloads that don't open, a broken ledger."""
    txn = _txn(spark, d)
    u = F.col("user_id")
    kind = F.when(u % 37 == 5, F.lit(None)).when(u % 41 == 6, "current").otherwise(F.col("account_type"))
    accounts = txn.select("user_id", "account_ref", kind.alias("account_type")).distinct()
    sid = F.concat_ws("/", "account_ref", u.cast("string"), F.date_format(F.trunc("value_date", "week"), "yyyy-MM-dd"))
    legs = txn.withColumns({"ingestion_event_id": sid, "readable": ~((u % 17 == 3) & (F.col("seq") % 5 == 0)), "amount_paise": F.when(~((u % 19 == 4) & (F.col("seq") % 7 == 0)), F.col("amount_paise"))})
    periods = views.statement_periods(txn).withColumn("readable", ~((u % 23 == 2) & (F.col("seq") % 3 == 0)))
    return balances.reports(accounts, periods, legs)


@query
def resolver_decision_rows(spark, d):
    rows = identity.with_identity(_txn(spark, d))
    sid = F.concat_ws("/", "account_ref", F.col("user_id").cast("string"), F.date_format(F.trunc("value_date", "week"), "yyyy-MM-dd"))
    rows = rows.withColumn("ingestion_event_id", sid)
    out = resolve.decision_rows(resolve.decisions(resolve.resolve(rows), rows))
    return out.select("user_id", "account_ref", "amount_paise", "transaction_type", "narration", "value_date", "ingestion_event_id", "idempotency_hash", "event_type")


def _decided(spark, d):
    rows = _named(spark, d)
    return classify.with_category(rows, classify.learned_rules(_corrections(rows))).withColumn("txn", F.col("seq"))


@query
def category_corrections(spark, d):
    asked = _corrections(_named(spark, d)).select("user_id", "txn", "category", "seq")
    return classify.corrected(_decided(spark, d), asked).select("user_id", "seq", "txn", "merchant", "category", "prior_category", "event_type", "corrected_by")


@query
def category_lookup(spark, d):
    """The category of every row asked for, or the error that nothing was decided."""
    return classify.look_up(_txn(spark, d).select("user_id", F.col("seq").alias("txn")), effective_category(spark, d))


def _natures(spark, d):
    names = F.array(*map(F.lit, ["essential_fixed", "essential_variable", "discretionary", "luxury"]))
    rows = views.ledger_long(spark, d).withColumns({"txn": F.col("seq"), "merchant": F.lit(None).cast("string"), "transaction_type": F.when(F.col("amount_paise") < 0, "expense").otherwise("income")})
    n = F.explode(F.array(F.lit(0), F.lit(1))).alias("n")
    asked = rows.where("seq % 29 = 3").select("user_id", "txn", "seq", n)
    return rows, asked.select("user_id", "txn", F.element_at(names, (F.pmod(F.col("txn") + F.col("n"), F.lit(4)) + 1).cast("int")).alias("nature"), (F.col("seq") * 2 + F.col("n")).alias("seq"))


@query
def nature_tag_corrected(spark, d):
    return classify.tag_nature(*_natures(spark, d)).select("seq", "nature", "nature_rule", "error")


@query
def effective_nature(spark, d):
    """Natures after corrections that came later than the tags."""
    rows, corrections = _natures(spark, d)
    tags = classify.tag_nature(rows, corrections.limit(0)).where("nature IS NOT NULL")
    return classify.effective_nature(tags, corrections)


def _extracted(spark, d):
    """Every week of the ledger as a printed statement, put into a folder and read from there: texts, cells, words."""
    heads = folders.kept(rendered.heads(_txn(spark, d)), "printed")
    rows = folders.kept(rendered.rows(_txn(spark, d), heads), "printed")
    path = folders.shared(spark, "statements")
    for unit, lines in (("texts", rendered.texts(heads, rows)), ("cells", rendered.cells(rows)), ("words", rendered.words(rows))):
        lines.write.json(f"{path}/{unit}")
    return tuple(statements.lines_of(spark, f"{path}/{unit}", unit) for unit in ("texts", "cells", "words"))


def _layout(one):
    return lambda spark, d: statements.read(*_extracted(spark, d), [one])[1].select("statement_id", "pos", "account_ref", "value_date", "narration", "amount_paise", "running_balance_paise", "occurrence_index", "idempotency_hash")


QUERIES |= {f"statement_rows_{one.name}": _layout(one) for one in statements.LAYOUTS}


@query
def statement_headers(spark, d):
    """Account, period, balances and check of every printed statement, or the reason why it doesn't read."""
    return statements.read(*_extracted(spark, d))[0]


COMMITTED = "ingestion_event_id string, user_id bigint, source_seq bigint, account_ref string, account_type string, value_date date, amount_paise bigint, idempotency_hash string, seq bigint, bucket int"


def _two_commits(spark, d, strict):
    """A log into which a third of the weekly statements went first and then every account's month, which overlaps them."""
    txn = folders.kept(identity.with_identity(_txn(spark, d)).withColumnRenamed("seq", "source_seq"), "ledger")
    path = folders.shared(spark, "log")
    for number, unit in enumerate(["week", "month"]):
        sid = F.concat_ws("/", "account_ref", F.col("user_id").cast("string"), F.date_format(F.trunc("value_date", unit), "yyyy-MM-dd"), F.lit(unit))
        rows = txn.select(sid.alias("ingestion_event_id"), "user_id", "source_seq", "account_ref", "account_type", "value_date", "amount_paise", "idempotency_hash")
        heads = rows.groupBy("ingestion_event_id", "user_id").agg(F.max("source_seq").alias("last"))
        heads = (heads.where("last % 9 = 0") if number == 0 else heads).select("ingestion_event_id", "user_id", F.when(F.col("user_id") % 10 == 7, "fail").otherwise("pass").alias("balance_check"), F.sha2("ingestion_event_id", 256).alias("content_hash"))
        if number == 0:  # the months' heads are those of all rows
            heads = folders.kept(heads, "heads")
            rows = folders.kept(rows.join(heads.select("ingestion_event_id"), "ingestion_event_id", "left_semi"), "rows")
        for _ in range(2):  # the second call finds the batch there
            commits.commit(heads, rows, path, unit, strict)
    return path


def _commit_report(spark, path):
    heads = commits.committed(spark, path, "statements", "ingestion_event_id string, user_id bigint, status string, records_added bigint, records_skipped bigint")
    held = commits.committed(spark, path, "events", COMMITTED).groupBy("ingestion_event_id").agg(F.count("*").alias("in_log"))
    return heads.join(held, "ingestion_event_id", "left").withColumn("in_log", F.coalesce("in_log", F.lit(0)))


@query
def commit_once_strict(spark, d):
    """Statements of two overlapping batches: one with a row that is in the log is refused whole."""
    return _commit_report(spark, _two_commits(spark, d, True))


@query
def commit_once_skipping(spark, d):
    """The same, but known rows are skipped."""
    return _commit_report(spark, _two_commits(spark, d, False))


@query
def commit_resolves(spark, d):
    """Decisions that the commits brought, by the rows' first numbers."""
    path = _two_commits(spark, d, False)
    source = commits.committed(spark, path, "events", COMMITTED).select("user_id", "seq", "source_seq")
    pairs = commits.committed(spark, path, "decisions", commits.PAIR)
    leg = lambda side: source.select("user_id", F.col("seq").alias(f"{side}_seq"), F.col("source_seq").alias(side))
    return pairs.join(leg("debit"), ["user_id", "debit_seq"]).join(leg("credit"), ["user_id", "credit_seq"]).groupBy("user_id", "matched_by").agg(F.count("*").alias("pairs"), F.countDistinct("debit").alias("debits"), F.countDistinct("credit").alias("credits"), F.sum("confidence").alias("confidence"))


def _purse_columns(states):
    part = lambda name: F.get_json_object("state", f"$.{name}").cast("bigint").alias(name)
    return states.select("user_id", part("paise"), part("spilled"), part("short"), part("events"), "last_seq")


def _mixed_events(spark, d):
    """Events of which every sixth has a type that no projection knows, and half are of the first version."""
    events = log.as_events(_txn(spark, d), old=F.col("seq") % 2 == 0)
    return events.withColumn("event_type", F.when(F.col("seq") % 6 == 5, "Unheard").otherwise(F.col("event_type")))


@query
def ordered_fold(spark, d):
    """A purse between two bounds, stepped through each user's events in order."""
    return _purse_columns(folds.fold(_mixed_events(spark, d), "purse"))


@query
def snapshot_fallback(spark, d):
    """The same from snapshots: the newest is broken, so an older one and the events after it make the state."""
    events, path = _mixed_events(spark, d), folders.shared(spark, "snapshots")
    first, last = events.agg(F.min("seq"), F.max("seq")).first()
    for part in (1, 2):
        upto = first + (last - first) * part // 3
        folder = snapshots.save(folds.fold(events.where(F.col("seq") <= upto), "purse"), path, "purse", upto)
    spark.createDataFrame([(0, "{}", 0)], "user_id long, state string, last_seq long").write.mode("append").parquet(f"{path}/purse/rows/{folder}")
    return _purse_columns(snapshots.current(events, path, "purse", "purse"))


@query
def key_history(spark, d):
    """Payloads of two keys a user, one made later; then every third user's first key is shredded."""
    events = log.as_events(_txn(spark, d))
    half = events.agg(F.expr("(min(seq) + max(seq)) div 2")).first()[0]
    users = events.select("user_id").distinct()
    made = lambda n: users.select((F.col("user_id") * 2 + n).alias("key_id"), "user_id", F.unhex(F.sha2(F.concat_ws(":", "user_id", F.lit(n)), 256)).alias("key"), F.lit(n).alias("created_at"), F.lit(None).cast("int").alias("deactivated_at"))
    old, both = made(0), made(0).unionByName(made(1))
    sealed = log.seal_by_key(events.where(F.col("seq") <= half), old).unionByName(log.seal_by_key(events.where(F.col("seq") > half), both))
    opened = log.open_by_key(sealed, log.shredded(both, (F.col("user_id") % 3 == 0) & (F.col("created_at") == 0), F.lit(2)))
    return opened.select("user_id", "seq", "key_id", F.col("payload").isNotNull().alias("readable"), log.field("amount_paise", "bigint"))


@query
def late_decryption(spark, d):
    """Net of the savings rows of January's first half: rows are picked by what isn't sealed, the rest is never opened."""
    txn = _txn(spark, d)
    keys = txn.select("user_id").distinct().select(F.col("user_id").alias("key_id"), "user_id", F.when(F.col("user_id") % 31 != 0, F.unhex(F.sha2(F.col("user_id").cast("string"), 256))).alias("key"))
    whole = keys.withColumns({"key": F.unhex(F.sha2(F.col("user_id").cast("string"), 256)), "created_at": F.lit(0), "deactivated_at": F.lit(None).cast("int")})
    routed = log.as_events(txn).join(txn.select("user_id", "seq", "value_date"), ["user_id", "seq"])
    opened = log.open_by_key(log.seal_by_key(routed, whole), keys).where("aggregate_id LIKE 'SAV%' AND value_date < DATE '2024-01-16'")
    return opened.groupBy("user_id", "aggregate_id").agg(F.count("*").alias("n"), F.count("payload").alias("readable"), F.sum(log.field("amount_paise", "bigint")).alias("net_paise"))


def _sid(unit="week"):
    return F.concat_ws("/", "account_ref", F.col("user_id").cast("string"), F.date_format(F.trunc("value_date", unit), "yyyy-MM-dd"))


@query
def pairings_with_periods(spark, d):
    """Decisions with role, hash, account and statement period of both legs; every seventh statement isn't known."""
    rows = identity.with_identity(_txn(spark, d)).withColumn("ingestion_event_id", _sid())
    out = ledger.pairing_report(resolve.resolve(rows), rows, views.statement_periods(_txn(spark, d)).where("seq % 7 <> 0"))
    part = lambda k, side: [F.col("legs")[k][c].alias(f"{side}_{c}") for c in ("role", "idempotency_hash", "account_ref", "period_start", "period_end")]
    return out.select("user_id", "matched_by", "confidence", "value_date", "debit_seq", "credit_seq", *part(0, "first"), *part(1, "second"))


@query
def sync_report(spark, d):
    """Printed statements with their counts by when they were made, newest first, stalled ones after 35 days."""
    heads = statement_headers(spark, d).where("reason IS NULL").join(views.statements(_txn(spark, d)).select(F.col("ingestion_event_id").alias("statement_id"), "user_id", "seq"), "statement_id")
    made = F.expr("timestamp'2024-03-20 00:00:00' - make_interval(0, 0, 0, seq * 13 % 80, 0, 0, 0)")
    fine = F.col("balance_check") != "fail"
    out = heads.select("user_id", F.col("statement_id").alias("ingestion_event_id"), "account_ref", "layout", "period_start", "period_end", F.when(fine, "ingested").otherwise("rejected").alias("status"), F.when(fine, F.col("row_count")).otherwise(0).alias("records_added"), F.lit(0).cast("bigint").alias("records_skipped"), "balance_check", "confidence", made.alias("created_at"))
    return ledger.sync_report(out, F.expr("timestamp'2024-03-20 00:00:00'")).drop("created_at").withColumn("n", F.lit(1))


@query
def overlap_pairs(spark, d):
    """Statements of one account whose periods meet: weeks and the months around them."""
    txn = _txn(spark, d)
    months = txn.groupBy("user_id", "account_ref", F.trunc("value_date", "month").alias("period_start")).agg(F.max("seq").alias("seq"))
    months = months.select(F.concat_ws("/", "account_ref", F.col("user_id").cast("string"), F.date_format("period_start", "yyyy-MM-dd"), F.lit("month")).alias("ingestion_event_id"), "user_id", "account_ref", "period_start", F.last_day("period_start").alias("period_end"), F.lit("ingested").alias("status"))
    return ledger.overlap_pairs(views.statement_periods(txn).select(months.columns).unionByName(months))


@query
def dashboard_series(spark, d):
    """Seven series by month, quarter and fiscal year, every user's periods without gaps."""
    return series.series(views.ledger_long(spark, d).withColumn("merchant", F.concat(F.lit("Shop "), F.col("seq") % 23)), "merchant")


@query
def dashboard_series_selected(spark, d):
    """The same for one stretch of days, which all series share."""
    return series.series(views.ledger_long(spark, d).withColumn("merchant", F.concat(F.lit("Shop "), F.col("seq") % 23)), "merchant", "1995-02-10", "1996-05-20", 3)


def _sure_by_length(texts):
    """A stand-in for a model: the first word, surer of longer texts."""
    return [(t.split(" ")[0].title(), 6000 + 400 * (len(t) % 10)) for t in texts]


@query
def model_decisions(spark, d):
    """Merchants that no rule knows, asked for once by text; the second half of the rows asks only for what is new to it."""
    rows = _named(spark, d).withColumn("text", F.when(F.col("merchant").isNull(), F.concat_ws(" ", F.upper("narration"), (F.col("seq") % 211).cast("string"))))
    half = rows.agg(F.expr("(min(seq) + max(seq)) div 2")).first()[0]
    path = folders.shared(spark, "answers")
    for number in range(2):
        stored = spark.read.schema(classify.ANSWER).parquet(path) if number else spark.createDataFrame([], classify.ANSWER)
        asked = rows.where(F.col("seq") <= half) if number == 0 else rows
        classify.ask_once(asked, stored, _sure_by_length, "merchant", "v1").write.mode("append").parquet(path)
    stored = spark.read.schema(classify.ANSWER).parquet(path)
    times = stored.groupBy("text").agg(F.count("*").alias("asked"))
    out = classify.with_answers(rows, stored, "text", "merchant", "merchant", "v1", classify.MERCHANT_LEAST)
    return out.join(times, "text", "left").select("user_id", "seq", "merchant", "merchant_confidence", "merchant_review", "asked")


@query
def statement_dates(spark, d):
    """Order dates as each layout prints dates, and back; every tenth is no date."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    kind = F.pmod("o_orderkey", F.lit(4))
    shown = F.when(kind == 0, F.date_format("day", "dd/MM/yyyy")).when(kind == 1, F.date_format("day", "dd/MM/yy")).when(kind == 2, F.date_format("day", "d MMM\nyyyy")).otherwise(F.date_format(F.add_months("day", 360), "d MMM ''yy"))
    shown = F.when(F.col("o_orderkey") % 10 == 9, F.lit("45/13/2024")).otherwise(shown)
    back = F.when(kind == 0, statements._date(shown, "dd/MM/yyyy")).when(kind == 1, statements._date(shown, "dd/MM/yy")).when(kind == 2, statements._date(shown, "d MMM yyyy")).otherwise(statements._spelled_year(shown))
    return o.select("o_orderkey", back.alias("value_date"))


@query
def rupee_text(spark, d):
    rows = views.ledger_long(spark, d)
    return rows.select("seq", c.indian_grouping(F.col("amount_paise") * (1 + F.col("seq") % 997)).alias("text"))


@query
def budget_rows_once(spark, d):
    """Spend of rows that came several times, each identity once; all of its rows must agree."""
    rows = views.ledger_long(spark, d).withColumn("idempotency_hash", F.sha2(F.col("seq").cast("string"), 256))
    again = rows.where("seq % 3 = 0").withColumn("seq", F.col("seq") + 1000000000)
    return budgets.net_spend(budgets.checked_once(rows.unionByName(again), "idempotency_hash"))


@query
def split_checked(spark, d):
    """Totals split by weight, of orders whose weights are fit for it."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.round(F.col("o_totalprice") * -100).cast("bigint").alias("total"))
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("weight")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return log.split_by_weight(log.fit_to_split(rows, "l_orderkey"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "weight"]).select("l_orderkey", "l_linenumber", "share_paise")


@query
def amount_types(spark, d):
    """Amounts in payloads that are whole numbers, and what else stands there: text, fractions, truth values, nothing."""
    k = F.pmod("seq", F.lit(6))
    raw = F.when(k == 1, F.concat(F.lit('"'), F.col("amount_paise"), F.lit('"'))).when(k == 2, F.concat(F.col("amount_paise").cast("string"), F.lit(".5"))).when(k == 3, F.lit("true")).when(k == 4, F.lit("null")).otherwise(F.col("amount_paise").cast("string"))
    return _txn(spark, d).select("seq", log.whole_number(F.concat(F.lit('{"amount_paise":'), raw, F.lit("}")), "amount_paise").alias("amount_paise"))


@query
def resolver_streamed(spark, d):
    """Decisions of a stream whose legs are keyed state: the first half of the rows, a restart, then the second half."""
    txn = _txn(spark, d).select("user_id", "seq", "account_type", "amount_paise", "value_date")
    half, path = txn.agg(F.expr("(min(seq) + max(seq)) div 2")).first()[0], folders.shared(spark, "stream")
    for part in (F.col("seq") <= half, F.col("seq") > half):
        txn.where(part).write.mode("append").parquet(f"{path}/rows")
        keyed.start(spark, spark.readStream.schema(txn.schema).parquet(f"{path}/rows"), f"{path}/decisions", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/decisions")


@query
def intake_statements(spark, d):
    """Printed statements taken in: what became of each, and how many of its rows the log holds."""
    path = folders.shared(spark, "log")
    owners = views.statements(_txn(spark, d)).select(F.col("ingestion_event_id").alias("statement_id"), "user_id")
    refused = intake.intake(*_extracted(spark, d), owners, path, "all")
    report = _commit_report(spark, path).select(F.col("ingestion_event_id").alias("statement_id"), "user_id", "status", F.lit(None).cast("string").alias("reason"), "records_added", "in_log")
    return report.unionByName(refused.select("statement_id", "user_id", F.lit("unread").alias("status"), "reason", F.lit(0).cast("bigint").alias("records_added"), F.lit(0).cast("bigint").alias("in_log")))


@query
def category_with_model(spark, d):
    """Categories by learned rules, rules, then stored answers of a stand-in for a model, asked once for each merchant."""
    rows = _named(spark, d)
    decided = classify.with_category(rows, classify.learned_rules(_corrections(rows)))
    decided = decided.withColumn("text", F.when(F.col("category").isNull(), F.col("merchant")))
    path = folders.shared(spark, "answers")
    classify.ask_once(decided, spark.createDataFrame([], classify.ANSWER), classify.stub_model("food_dining"), "category", "v1").write.parquet(path)
    out = classify.with_answers(decided, spark.read.schema(classify.ANSWER).parquet(path), "text", "category", "category", "v1", classify.CATEGORY_LEAST)
    return out.select("user_id", "seq", "category", "category_review")
