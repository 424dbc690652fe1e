"""The ledger queries as DuckDB SQL over the test tables, written apart from the DataFrame code."""

from __future__ import annotations

TEXTS = "['Swiggy  order', 'ZOMATO ltd', 'amazon pay', 'ATM wdl', 'NEFT CR salary', 'IMPS p2a', 'UPI ref', 'Rent  paid']"
CATEGORIES = "['food_dining', 'groceries', 'transport', 'shopping', 'entertainment', 'utilities', 'rent_housing', 'health_medical', 'education', 'travel', 'investments', 'transfers', 'insurance', 'subscriptions', 'income', 'other']"
FLOWS = "('income', 'transfers', 'investments')"

TXN = f"""txn AS (
  SELECT CAST(user_id AS BIGINT) AS user_id, event_id AS seq,
    CASE event_type WHEN 'purchase' THEN 'credit_card' WHEN 'error' THEN 'fd' ELSE 'savings' END AS account_type,
    CASE event_type WHEN 'purchase' THEN 'CARD_' WHEN 'error' THEN 'FD_' ELSE 'SAV_' END || CAST(user_id % 2 AS VARCHAR) AS account_ref,
    (CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END) * (CAST(floor(value / 20) AS BIGINT) * 2000 + 2000) AS amount_paise,
    CAST(ts AS DATE) AS value_date,
    ({TEXTS})[CAST(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) % 8 + 1 AS INTEGER)] AS narration,
    coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k
  FROM events)"""
ID = """canon AS (
  SELECT *, upper(trim(regexp_replace(narration, '\\s+', ' ', 'g'))) AS canonical_narration FROM txn
), ord AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id, account_ref, value_date, amount_paise, canonical_narration ORDER BY seq) - 1 AS INTEGER) AS occurrence_index FROM canon
), ident AS (
  SELECT *, sha256(account_ref || '|' || strftime(value_date, '%Y-%m-%d') || '|' || CAST(amount_paise AS VARCHAR) || '|' || canonical_narration || '|' || CAST(occurrence_index AS VARCHAR)) AS idempotency_hash FROM ord)"""
STATEMENTS = """weekly AS (
  SELECT user_id, account_ref, account_type, CAST(date_trunc('week', value_date) AS DATE) AS period_start,
    CAST(sum(amount_paise) AS BIGINT) AS net, count(*) AS row_count, max(seq) AS seq FROM txn GROUP BY ALL
), summed AS (
  SELECT *, CAST(100000 + sum(net) OVER (PARTITION BY user_id, account_ref ORDER BY period_start) AS BIGINT) AS total FROM weekly
), st AS (
  SELECT account_ref || '/' || CAST(user_id AS VARCHAR) || '/' || strftime(period_start, '%Y-%m-%d') AS ingestion_event_id,
    user_id, account_ref, account_type, period_start, period_start + 6 AS period_end, total - net AS opening_paise,
    total + CASE WHEN user_id % 11 = 0 AND row_count % 3 = 0 THEN 1 ELSE 0 END AS closing_paise, row_count, seq, net
  FROM summed
), per AS (
  SELECT ingestion_event_id, user_id, account_ref, account_type, period_start,
    CASE WHEN user_id % 13 = 0 THEN period_end + 3 ELSE period_end END AS period_end,
    CASE WHEN user_id % 17 = 0 AND seq % 4 = 0 THEN 'rejected' ELSE 'ingested' END AS status, opening_paise,
    CASE WHEN user_id % 19 = 0 AND seq % 5 = 0 THEN NULL ELSE closing_paise END AS closing_paise,
    CASE WHEN opening_paise + net = closing_paise THEN 'pass' ELSE 'fail' END AS balance_check, row_count, seq
  FROM st)"""
LONG = f"""lng AS (
  SELECT CAST(o_custkey % 200 AS BIGINT) AS user_id, o_orderkey AS seq, 'SAV_' || CAST(o_custkey % 3 AS VARCHAR) AS account_ref,
    CAST(o_orderdate AS DATE) AS value_date,
    CASE WHEN o_orderstatus = 'O' THEN 1 ELSE -1 END * CAST(round(o_totalprice * 100) AS BIGINT) AS amount_paise,
    CASE WHEN o_orderkey % 17 < 16 THEN ({CATEGORIES})[CAST(o_orderkey % 17 + 1 AS INTEGER)] END AS category
  FROM orders)"""


def cascade(priorities: str = "(0), (1), (2), (3)", source: str = "txn", n: str = "") -> str:
    """Pairs of the given matchers, by stepping through (matcher, debit) in order within each user and size.

    `source`: the rows; `n`: what the names of the steps end in.
    """
    return f"""legs{n} AS (
  SELECT user_id, abs(amount_paise) AS size, seq, account_type AS t, value_date AS v, amount_paise < 0 AS is_debit FROM {source} WHERE amount_paise <> 0
), credits{n} AS (
  SELECT user_id, size, list(struct_pack(s := seq, t := t, v := v) ORDER BY seq) AS cs FROM legs{n} WHERE NOT is_debit GROUP BY ALL
), tasks{n} AS (
  SELECT user_id, size, seq, t, v, p, row_number() OVER (PARTITION BY user_id, size ORDER BY p, seq) AS step
  FROM legs{n}, (VALUES {priorities}) m(p) WHERE is_debit AND (p = 3 OR t = 'savings')
), steps{n} AS (
  SELECT user_id, size, CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS claimed, CAST(NULL AS BIGINT) AS d, CAST(NULL AS BIGINT) AS c, CAST(NULL AS INTEGER) AS p, CAST(NULL AS BIGINT) AS gap FROM credits{n}
  UNION ALL
  SELECT r.user_id, r.size, k.step, CASE WHEN hit.s IS NULL THEN r.claimed ELSE list_concat(r.claimed, [k.seq, hit.s]) END, k.seq, hit.s, k.p, abs(date_diff('day', k.v, hit.v))
  FROM steps{n} r JOIN tasks{n} k ON k.user_id = r.user_id AND k.size = r.size AND k.step = r.step + 1
  JOIN credits{n} q ON q.user_id = r.user_id AND q.size = r.size,
  LATERAL (SELECT CASE WHEN list_contains(r.claimed, k.seq) THEN NULL ELSE list_filter(q.cs, lambda x: abs(date_diff('day', k.v, x.v)) <= 2 AND NOT list_contains(r.claimed, x.s)
    AND x.t = CASE k.p WHEN 0 THEN 'savings' WHEN 1 THEN 'credit_card' WHEN 2 THEN 'fd' ELSE k.t END)[1] END AS hit)
), pairs{n} AS (
  SELECT user_id, d AS debit_seq, c AS credit_seq, CASE p WHEN 0 THEN 'transfer' WHEN 1 THEN 'credit_card_payment' WHEN 2 THEN 'fd_booking' ELSE 'reversal' END AS matched_by,
    CAST(CASE WHEN gap = 0 THEN 9500 ELSE 9000 - 200 * gap END AS INTEGER) AS confidence FROM steps{n} WHERE c IS NOT NULL)"""


REASONS = """reasons AS (
  SELECT user_id, s AS seq, arg_max(matched_by, struct_pack(a := latest, b := debit_seq)) AS reason FROM (
    SELECT user_id, debit_seq AS s, matched_by, greatest(debit_seq, credit_seq) AS latest, debit_seq FROM pairs
    UNION ALL SELECT user_id, credit_seq, matched_by, greatest(debit_seq, credit_seq), debit_seq FROM pairs) GROUP BY 1, 2)"""
MERCHANT = """CASE WHEN upper(narration) LIKE '%SWIGGY%' THEN 'Swiggy' WHEN upper(narration) LIKE '%ZOMATO%' THEN 'Zomato'
  WHEN upper(narration) LIKE '%AMAZON%' THEN 'Amazon' WHEN upper(narration) LIKE '%ATM%' THEN 'ATM Withdrawal'
  WHEN upper(narration) LIKE '%NEFT CR%' OR upper(narration) LIKE '%NEFT-CR%' THEN 'NEFT Credit' WHEN upper(narration) LIKE '%IMPS%' THEN 'IMPS Transfer' END"""
RULE = "CASE upper(merchant) WHEN 'SWIGGY' THEN 'food_dining' WHEN 'ZOMATO' THEN 'food_dining' WHEN 'AMAZON' THEN 'shopping' WHEN 'UBER' THEN 'transport' WHEN 'OLA' THEN 'transport' WHEN 'NETFLIX' THEN 'subscriptions' WHEN 'BIGBASKET' THEN 'groceries' WHEN 'NEFT CREDIT' THEN 'income' END"
NATURE = "CASE WHEN category IN ('rent_housing', 'insurance') THEN 'essential_fixed' WHEN category IN ('groceries', 'utilities', 'health_medical', 'education') THEN 'essential_variable' WHEN category IN ('food_dining', 'entertainment', 'shopping', 'transport', 'subscriptions') THEN 'discretionary' WHEN category = 'travel' THEN 'luxury' END"
MERCHANTS = f"named AS (SELECT *, {MERCHANT} AS merchant FROM txn)"
CORRECTIONS = f"corr AS (SELECT user_id, merchant, seq AS txn, ({CATEGORIES})[CAST(seq % 16 + 1 AS INTEGER)] AS category, seq FROM named WHERE seq % 37 = 0)"
LEARNED = "learned AS (SELECT user_id, merchant, arg_max(category, seq) AS learned FROM corr WHERE merchant IS NOT NULL GROUP BY 1, 2)"
CLASSIFIED = f"cls AS (SELECT n.user_id, n.seq, n.value_date, n.amount_paise, n.merchant, coalesce(l.learned, {RULE.replace('merchant', 'n.merchant')}) AS category FROM named n LEFT JOIN learned l ON n.user_id = l.user_id AND n.merchant = l.merchant)"
SPEND = f"spend AS (SELECT user_id, category, CAST(date_trunc('month', value_date) AS DATE) AS month, CAST(-sum(amount_paise) AS BIGINT) AS spent_paise FROM lng WHERE category IS NOT NULL AND category NOT IN {FLOWS} GROUP BY ALL)"
FIGURES = f"""fig AS (
  SELECT user_id, CAST(date_trunc('month', value_date) AS DATE) AS month,
    CAST(coalesce(-sum(amount_paise) FILTER (category NOT IN {FLOWS} OR (category IS NULL AND amount_paise < 0)), 0) AS BIGINT) AS expense_paise,
    CAST(coalesce(sum(amount_paise) FILTER (category = 'income' AND amount_paise > 0), 0) AS BIGINT) AS income_paise,
    CAST(coalesce(sum(amount_paise) FILTER (category NOT IN {FLOWS} AND amount_paise > 0), 0) AS BIGINT) AS refund_paise,
    CAST(coalesce(-sum(amount_paise) FILTER (category NOT IN {FLOWS}), 0) AS BIGINT) AS categorised_paise,
    CAST(coalesce(-sum(amount_paise) FILTER (category IS NULL AND amount_paise < 0), 0) AS BIGINT) AS uncategorised_paise
  FROM lng GROUP BY ALL
), fig2 AS (
  SELECT *, income_paise - expense_paise AS net_paise, CASE WHEN income_paise > 0 THEN
    (CAST(income_paise - expense_paise AS HUGEINT) * 10000 - (((CAST(income_paise - expense_paise AS HUGEINT) * 10000) % income_paise) + income_paise) % income_paise) // income_paise END AS bps FROM fig)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(parts) + "\n"


def _pairs(select: str, *more: str, priorities: str = "(0), (1), (2), (3)") -> str:
    return _with(TXN, cascade(priorities), *more, recursive=True) + select


PAIR = "SELECT user_id, debit_seq, credit_seq, matched_by, confidence FROM pairs"
BALANCE = """anchor AS (
  SELECT * FROM per WHERE status = 'ingested' AND balance_check = 'pass' AND closing_paise IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY user_id, account_ref ORDER BY period_end DESC, seq DESC) = 1
), legs AS (
  SELECT *, account_ref || '/' || CAST(user_id AS VARCHAR) || '/' || strftime(CAST(date_trunc('week', value_date) AS DATE), '%Y-%m-%d') || CASE WHEN user_id % 29 = 0 AND seq % 7 = 0 THEN '?' ELSE '' END AS sid FROM txn
), bal AS (
  SELECT l.user_id, l.account_ref, any_value(a.ingestion_event_id) AS anchor_id,
    CASE WHEN any_value(a.closing_paise) IS NOT NULL THEN CAST(any_value(a.closing_paise) + coalesce(sum(l.amount_paise) FILTER (p.period_end > a.period_end), 0) AS BIGINT) END AS balance_paise,
    any_value(a.closing_paise) IS NOT NULL AND bool_or(p.period_end IS NULL) AS is_stale
  FROM legs l LEFT JOIN per p ON p.ingestion_event_id = l.sid LEFT JOIN anchor a ON a.user_id = l.user_id AND a.account_ref = l.account_ref GROUP BY 1, 2)"""
VIEW = "view AS (SELECT t.*, r.reason, r.reason IS NULL AS is_counted FROM txn t LEFT JOIN reasons r ON t.user_id = r.user_id AND t.seq = r.seq)"


def _totals(income: str, expense: str) -> str:
    return f"""SELECT user_id, CAST(coalesce(sum(amount_paise) FILTER (is_counted AND {income}), 0) AS BIGINT) AS income_paise,
  CAST(coalesce(sum(abs(amount_paise)) FILTER (is_counted AND {expense}), 0) AS BIGINT) AS expense_paise,
  count(*) FILTER (NOT is_counted) AS excluded_count, count(*) AS transaction_count FROM view GROUP BY 1"""


def _trend(value: str) -> str:
    return _with(LONG, FIGURES) + f"SELECT user_id, month, {value}, {value} - lag({value}) OVER (PARTITION BY user_id ORDER BY month) AS change FROM fig2"


ORACLE = {
    "canonical_narration_ascii": _with(TXN, ID) + "SELECT user_id, seq, canonical_narration FROM canon",
    "occurrence_index": _with(TXN, ID) + "SELECT user_id, seq, occurrence_index FROM ord",
    "idempotency_hash": _with(TXN, ID) + "SELECT user_id, seq, idempotency_hash FROM ident",
    "amount_parse_cr_dr": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN -1 ELSE 1 END * CAST(round(o_totalprice * 100) AS BIGINT) AS amount_paise FROM orders",
    "amount_parse_plain": "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_paise FROM orders",
    "fiscal_year_quarter": "SELECT event_id, CAST(year(d) - CASE WHEN month(d) < 4 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year, CAST(((month(d) + 8) % 12) // 3 + 1 AS INTEGER) AS fiscal_quarter FROM (SELECT event_id, ts + INTERVAL 330 MINUTE AS d FROM events)",
    "month_buckets": _with(LONG) + "SELECT user_id, CAST(date_trunc('month', value_date) AS DATE) AS month, count(*) AS n, CAST(sum(amount_paise) AS BIGINT) AS net_paise FROM lng GROUP BY ALL",
    "largest_remainder_split": """WITH w AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(o_totalprice * 100) AS BIGINT) AS total, CAST(l_quantity AS BIGINT) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), s AS (SELECT *, CAST(sum(weight) OVER (PARTITION BY l_orderkey) AS BIGINT) AS whole FROM w WHERE weight >= 0
), q AS (SELECT *, (total * weight) // whole AS base, (total * weight) % whole AS rest FROM s WHERE whole > 0
), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY rest DESC, l_linenumber, l_partkey, l_suppkey, weight) AS place, total - CAST(sum(base) OVER (PARTITION BY l_orderkey) AS BIGINT) AS missing FROM q)
SELECT l_orderkey, l_linenumber, base + CASE WHEN place <= missing THEN 1 ELSE 0 END AS share_paise FROM r""",
    "round_nearest_10": _with(LONG) + "SELECT seq, CAST(floor((amount_paise + 5) / 10.0) AS BIGINT) * 10 AS rounded_paise FROM lng",
    "balance_check": _with(TXN, STATEMENTS) + "SELECT ingestion_event_id, CASE WHEN opening_paise + net = closing_paise THEN 'pass' ELSE 'fail' END AS balance_check FROM st",
    "opening_closing_inference": _with(TXN, STATEMENTS) + "SELECT ingestion_event_id, opening_paise, opening_paise + net AS closing_paise FROM st",
    "running_balance_check": _with(TXN, STATEMENTS) + "SELECT t.user_id, t.seq, CAST(s.opening_paise + sum(t.amount_paise) OVER (PARTITION BY s.ingestion_event_id ORDER BY t.seq) AS BIGINT) AS running_balance_paise FROM txn t JOIN st s ON s.user_id = t.user_id AND s.account_ref = t.account_ref AND t.value_date BETWEEN s.period_start AND s.period_end",
    **{f"resolver_{n}": _pairs(PAIR, priorities=f"({k})") for k, n in enumerate(["transfer", "cc", "fd", "reversal"])},
    "resolver_cascade": _pairs(PAIR),
    "resolver_incremental": _with(TXN, cascade(source="early", n="1").replace("legs1 AS", "early AS (SELECT * FROM txn WHERE seq <= (SELECT (min(seq) + max(seq)) // 2 FROM txn)), legs1 AS", 1), cascade(source="late", n="2").replace("legs2 AS", "late AS (SELECT * FROM txn WHERE (user_id, seq) NOT IN (SELECT (user_id, debit_seq) FROM pairs1 UNION ALL SELECT (user_id, credit_seq) FROM pairs1)), legs2 AS", 1), recursive=True) + "SELECT * FROM pairs1 UNION ALL SELECT * FROM pairs2",
    "resolver_decision_hash": _with(TXN, ID, cascade(), recursive=True) + "SELECT p.user_id, debit_seq, credit_seq, sha256(matched_by || ':' || least(a.idempotency_hash, b.idempotency_hash) || ':' || greatest(a.idempotency_hash, b.idempotency_hash)) AS decision_hash FROM pairs p JOIN ident a ON a.seq = debit_seq JOIN ident b ON b.seq = credit_seq",
    "transactions_view": _pairs("SELECT user_id, seq, account_ref, amount_paise, value_date, is_counted FROM view", REASONS, VIEW),
    "transactions_view_totals_literal": _pairs(_totals("false", "false"), REASONS, VIEW),
    "transactions_view_totals_derived": _pairs(_totals("amount_paise > 0", "amount_paise < 0"), REASONS, VIEW),
    "exclusion_reasons": _pairs("SELECT user_id, seq, reason FROM reasons", REASONS),
    "dedup_ledger": _with(TXN, STATEMENTS, cascade(), REASONS, VIEW, recursive=True) + "SELECT v.user_id, v.seq, v.is_counted, v.reason, count(p.seq) AS covering_count FROM view v LEFT JOIN per p ON p.user_id = v.user_id AND p.account_ref = v.account_ref AND p.status <> 'rejected' AND v.value_date BETWEEN p.period_start AND p.period_end GROUP BY ALL",
    "dedup_ledger_range": _pairs("SELECT user_id, count(*) AS n, count(*) FILTER (is_counted) AS counted, count(*) FILTER (NOT is_counted) AS excluded FROM view WHERE value_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' GROUP BY 1", REASONS, VIEW),
    "covering_statements": _with(TXN, STATEMENTS) + "SELECT t.user_id, t.seq, count(p.ingestion_event_id) AS covering_count, coalesce(string_agg(p.ingestion_event_id, ',' ORDER BY p.ingestion_event_id), '') AS covering_ids FROM txn t LEFT JOIN per p ON p.user_id = t.user_id AND p.account_ref = t.account_ref AND p.status <> 'rejected' AND t.value_date BETWEEN p.period_start AND p.period_end GROUP BY 1, 2",
    "overlap_map": _with(TXN, STATEMENTS) + "SELECT a.ingestion_event_id, count(b.ingestion_event_id) AS overlap_count, coalesce(string_agg(b.ingestion_event_id, ',' ORDER BY b.ingestion_event_id), '') AS overlapping_ids FROM per a LEFT JOIN per b ON a.user_id = b.user_id AND a.account_ref = b.account_ref AND a.ingestion_event_id <> b.ingestion_event_id AND b.status <> 'rejected' AND a.period_start <= b.period_end AND b.period_start <= a.period_end WHERE a.status <> 'rejected' GROUP BY 1",
    "sync_history": _with(TXN, STATEMENTS) + "SELECT ingestion_event_id, user_id, account_ref, status, period_end, date_diff('day', period_end, DATE '2024-02-20') > 35 AS is_stalled FROM per",
    "resolver_pairings": _pairs("SELECT p.user_id, matched_by, confidence, CASE matched_by WHEN 'transfer' THEN 'debit/credit' WHEN 'credit_card_payment' THEN 'savings_debit/cc_credit' WHEN 'fd_booking' THEN 'savings_debit/fd_credit' ELSE 'original/reversal' END AS roles, debit_seq, credit_seq, a.account_ref AS debit_account, b.account_ref AS credit_account, a.value_date AS debit_date, b.value_date AS credit_date FROM pairs p JOIN txn a ON a.seq = debit_seq JOIN txn b ON b.seq = credit_seq"),
    "account_transactions": _with(TXN) + "SELECT user_id, account_ref, seq, value_date, amount_paise FROM txn WHERE value_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'",
    "anchor_selection": _with(TXN, STATEMENTS, BALANCE) + "SELECT user_id, account_ref, ingestion_event_id AS anchor_id, closing_paise AS anchor_paise, period_end AS anchor_end FROM anchor",
    "account_balance": _with(TXN, STATEMENTS, BALANCE) + "SELECT user_id, account_ref, anchor_id, balance_paise FROM bal",
    "card_liability": _with(TXN, STATEMENTS, BALANCE) + "SELECT user_id, account_ref, -balance_paise AS liability_paise FROM bal WHERE account_ref LIKE 'CARD%'",
    "stale_accounts": _with(TXN, STATEMENTS, BALANCE) + "SELECT user_id, account_ref FROM bal WHERE is_stale",
    "account_type_mismatch": _with(TXN, STATEMENTS) + "SELECT DISTINCT user_id, account_ref, CASE WHEN user_id % 23 = 0 THEN 'current' ELSE account_type END AS account_type, account_type AS other_types FROM per WHERE user_id % 23 = 0 AND account_type <> 'savings'",
    "merchant_normalise": _with(TXN, MERCHANTS) + "SELECT user_id, seq, merchant FROM named",
    "learned_rules": _with(TXN, MERCHANTS, CORRECTIONS, LEARNED) + "SELECT user_id, merchant, learned FROM learned",
    "category_classify": _with(TXN, MERCHANTS, CORRECTIONS, LEARNED, CLASSIFIED) + "SELECT user_id, seq, category FROM cls",
    "effective_category": _with(TXN, MERCHANTS, CORRECTIONS, LEARNED, CLASSIFIED) + "SELECT c.user_id, c.seq AS txn, coalesce(k.category, c.category) AS category FROM cls c LEFT JOIN corr k ON k.user_id = c.user_id AND k.txn = c.seq WHERE coalesce(k.category, c.category) IS NOT NULL",
    "nature_tag": _with(LONG) + f"SELECT seq, {NATURE} AS nature FROM lng WHERE amount_paise < 0",
    "running_cost_split": _with(LONG) + f"SELECT user_id, CAST(coalesce(-sum(amount_paise) FILTER (nature = 'essential_fixed'), 0) AS BIGINT) AS essential_fixed, CAST(coalesce(-sum(amount_paise) FILTER (nature = 'essential_variable'), 0) AS BIGINT) AS essential_variable, CAST(coalesce(-sum(amount_paise) FILTER (nature = 'discretionary'), 0) AS BIGINT) AS discretionary, CAST(coalesce(-sum(amount_paise) FILTER (nature = 'luxury'), 0) AS BIGINT) AS luxury, CAST(coalesce(-sum(amount_paise) FILTER (nature IN ('essential_fixed', 'essential_variable')), 0) AS BIGINT) AS running_paise FROM (SELECT *, {NATURE} AS nature FROM lng) WHERE nature IS NOT NULL GROUP BY 1",
    "budget_net_spend": _with(LONG, SPEND) + "SELECT user_id, category, month, spent_paise FROM spend",
    "budget_projection": _with(LONG, SPEND) + f"""SELECT b.user_id, b.category, b.month, b.target_paise, coalesce(s.spent_paise, 0) AS spent_paise, b.target_paise - coalesce(s.spent_paise, 0) AS remaining_paise,
  CAST(CASE WHEN b.target_paise > 0 AND coalesce(s.spent_paise, 0) > 0 THEN (CAST(s.spent_paise AS HUGEINT) * 10000) // b.target_paise ELSE 0 END AS BIGINT) AS used_bps
  FROM (SELECT DISTINCT user_id, category, CAST(date_trunc('month', value_date) + to_months(k) AS DATE) AS month, (user_id % 5) * 10000000 AS target_paise FROM lng, (VALUES (0), (1)) AS m(k) WHERE category IS NOT NULL AND category NOT IN {FLOWS}) b
  LEFT JOIN spend s ON s.user_id = b.user_id AND s.category = b.category AND s.month = b.month""",
    "kpi_strip": _with(LONG, FIGURES) + "SELECT user_id, month, expense_paise, income_paise, refund_paise, net_paise, CAST(bps AS BIGINT) AS savings_bps FROM fig2",
    "kpi_reconciliation": _with(LONG, FIGURES) + "SELECT user_id, CAST(sum(expense_paise) AS BIGINT) AS expense_paise, CAST(sum(categorised_paise + uncategorised_paise) AS BIGINT) AS parts_paise FROM fig2 GROUP BY 1",
    "trend_income_expense": _with(LONG, FIGURES) + "SELECT user_id, month, income_paise, expense_paise FROM fig2",
    "category_trend": _with(LONG, SPEND) + "SELECT user_id, category, month, spent_paise, spent_paise - lag(spent_paise) OVER (PARTITION BY user_id, category ORDER BY month) AS change FROM spend",
    "net_cashflow_trend": _trend("net_paise"),
    "savings_rate_trend": _with(LONG, FIGURES) + "SELECT user_id, month, CAST(bps AS BIGINT) AS savings_bps, CAST(bps - lag(bps) OVER (PARTITION BY user_id ORDER BY month) AS BIGINT) AS change FROM fig2",
    "top_merchants": _with(TXN, MERCHANTS) + "SELECT user_id, merchant, CAST(-sum(amount_paise) AS BIGINT) AS spent_paise, CAST(row_number() OVER (PARTITION BY user_id ORDER BY -sum(amount_paise) DESC, merchant) AS INTEGER) AS place FROM named WHERE merchant IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY -sum(amount_paise) DESC, merchant) <= 10",
    "events_list_counts": _with(TXN) + "SELECT user_id, count(*) AS events, min(seq) AS first_seq, max(seq) AS last_seq FROM txn GROUP BY 1",
    "upcast_chain": _with(TXN) + "SELECT user_id, seq, 2 AS event_version, narration, amount_paise FROM txn",
    "payload_roundtrip": _with(TXN) + "SELECT user_id, seq, user_id % 31 <> 0 AS readable, CASE WHEN user_id % 31 <> 0 THEN narration END AS narration FROM txn",
}

STAGED = """staged AS (
  SELECT ingestion_event_id, user_id, account_ref, seq, CASE WHEN seq % 13 <> 0 THEN balance_check ELSE 'not_applicable' END AS chk FROM per
  WHERE seq * 37 % 7200 + 3600 > 5400 AND seq % 10 <> 3
), moved AS (
  SELECT *, account_ref || '/' || CAST(user_id AS VARCHAR) || '/' || strftime(CAST(date_trunc('week', value_date) AS DATE), '%Y-%m-%d') AS sid FROM txn
), counted AS (SELECT sid, count(*) AS n, CAST(sum(amount_paise) AS BIGINT) AS net FROM moved GROUP BY 1)"""
CHANGES = """chg AS (
  SELECT o_custkey AS account_id, CASE WHEN o_orderkey % 7 < 3 THEN 'create' WHEN o_orderkey % 7 < 6 THEN 'patch' ELSE 'deactivate' END AS op, o_orderkey AS seq,
    o_custkey % 200 AS user_id, 'SAV_' || CAST(o_orderkey AS VARCHAR) AS account_ref, CASE WHEN o_orderkey % 5 > 0 THEN substr(o_orderpriority, 3, 128) END AS nickname,
    CASE o_orderkey % 4 WHEN 1 THEN 'current' WHEN 2 THEN 'credit_card' WHEN 3 THEN 'loan' END AS account_type,
    CASE WHEN o_orderkey % 3 > 0 THEN substr(CASE WHEN length(CAST(o_orderkey AS VARCHAR)) > 6 THEN CAST(o_orderkey AS VARCHAR)[:6] ELSE lpad(CAST(o_orderkey AS VARCHAR), 6, '0') END, 3, 4) END AS last4
  FROM orders)"""
EXPENSES = f"category IS NOT NULL AND category NOT IN {FLOWS}"
BUDGETS = f"""bch AS (
  SELECT user_id, category, CAST(date_trunc('month', value_date) - to_months(CAST((month(value_date) - 1) % 6 AS INTEGER)) AS DATE) AS month, seq * 100 AS target_paise,
    CASE WHEN seq % 5 < 2 THEN 'create' WHEN seq % 5 < 4 THEN 'patch' ELSE 'delete' END AS op, seq FROM lng WHERE {EXPENSES}
), bst AS (
  SELECT *, (SELECT arg_max(b.op, b.seq) FROM bch b WHERE b.user_id = a.user_id AND b.category = a.category AND b.month = a.month AND b.seq < a.seq AND b.op <> 'patch') AS state FROM bch a
), bout AS (
  SELECT *, CASE WHEN op = 'create' AND state = 'create' THEN 'budget_duplicate' WHEN op <> 'create' AND coalesce(state, 'delete') <> 'create' THEN 'not_found' END AS code FROM bst)"""
WEEK = "account_ref || '/' || CAST(user_id AS VARCHAR) || '/' || strftime(CAST(date_trunc('week', value_date) AS DATE), '%Y-%m-%d')"
REPORTS = f"""acc AS (
  SELECT DISTINCT user_id, account_ref, CASE WHEN user_id % 37 = 5 THEN NULL WHEN user_id % 41 = 6 THEN 'current' ELSE account_type END AS account_type FROM txn
), rp AS (SELECT *, NOT (user_id % 23 = 2 AND seq % 3 = 0) AS readable FROM per
), rl AS (SELECT user_id, account_ref, seq, {WEEK} AS sid, NOT (user_id % 17 = 3 AND seq % 5 = 0) AS readable, CASE WHEN NOT (user_id % 19 = 4 AND seq % 7 = 0) THEN amount_paise END AS amount_paise FROM txn
), ra AS (
  SELECT * FROM rp WHERE readable AND status = 'ingested' AND balance_check = 'pass' AND closing_paise IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY user_id, account_ref ORDER BY period_end DESC, seq DESC) = 1
), rb AS (
  SELECT c.user_id, c.account_ref, c.account_type,
    CASE WHEN c.account_type IS NULL THEN 'account_type_missing' WHEN c.account_type NOT IN ('savings', 'current', 'credit_card') THEN 'balance_not_supported_for_account_type'
      WHEN EXISTS (SELECT 1 FROM rp p WHERE p.user_id = c.user_id AND p.account_ref = c.account_ref AND NOT p.readable) THEN 'statement_decryption_failed'
      WHEN EXISTS (SELECT 1 FROM rp p WHERE p.user_id = c.user_id AND p.account_ref = c.account_ref AND p.account_type <> replace(c.account_type, 'current', 'savings')) THEN 'account_type_mismatch'
      WHEN EXISTS (SELECT 1 FROM rl l WHERE l.user_id = c.user_id AND l.account_ref = c.account_ref AND NOT l.readable) THEN 'transaction_decryption_failed'
      WHEN EXISTS (SELECT 1 FROM rl l WHERE l.user_id = c.user_id AND l.account_ref = c.account_ref AND l.amount_paise IS NULL) THEN 'ledger_integrity_error' END AS code,
    a.period_end, a.closing_paise + coalesce((SELECT sum(l.amount_paise) FROM rl l JOIN rp p ON p.ingestion_event_id = l.sid WHERE p.readable AND l.user_id = c.user_id AND l.account_ref = c.account_ref AND p.period_end > a.period_end), 0) AS total
  FROM acc c LEFT JOIN ra a ON a.user_id = c.user_id AND a.account_ref = c.account_ref)"""
NATURES_OF = NATURE.rsplit(" END", 1)[0] + " END"
CORRECTED = "nat AS (SELECT user_id, seq AS txn, (['essential_fixed', 'essential_variable', 'discretionary', 'luxury'])[CAST((seq + 1) % 4 + 1 AS INTEGER)] AS mine FROM lng WHERE seq % 29 = 3)"

ORACLE |= {
    "content_hash": "SELECT event_id, sha256(props) AS content_hash FROM events",
    "money_text": _with(LONG) + "SELECT seq, CAST(amount_paise * 1000003 AS VARCHAR) AS text, amount_paise * 1000003 AS back_paise FROM lng",
    "upload_preview": _with(TXN, STATEMENTS, STAGED) + "SELECT ingestion_event_id AS session_id, user_id, chk AS balance_check, 9500 AS confidence, coalesce(n, 0) AS row_count, coalesce(net, 0) AS net_paise FROM staged LEFT JOIN counted ON sid = ingestion_event_id",
    "commit_statements": _with(TXN, STATEMENTS, STAGED) + "SELECT ingestion_event_id, user_id, CASE WHEN chk = 'fail' THEN 'rejected' ELSE 'ingested' END AS status, CASE WHEN chk = 'fail' THEN 0 ELSE coalesce(n, 0) END AS records_added, sha256(ingestion_event_id) AS content_hash, chk = 'fail' AS retained FROM staged LEFT JOIN counted ON sid = ingestion_event_id",
    "commit_events": _with(TXN, STATEMENTS, STAGED) + "SELECT ingestion_event_id, m.user_id, m.seq, amount_paise, CASE WHEN amount_paise < 0 THEN 'debit' ELSE 'credit' END AS transaction_type, 'TransactionIngested' AS event_type FROM moved m JOIN staged s ON m.sid = s.ingestion_event_id WHERE chk <> 'fail'",
    "append_order": _with(TXN) + "SELECT user_id, seq AS source_seq, CAST(row_number() OVER (PARTITION BY user_id ORDER BY seq) AS INTEGER) AS place, true AS is_after FROM txn",
    "account_stream": _with(TXN) + "SELECT user_id, seq, account_ref AS aggregate_id, amount_paise FROM txn WHERE account_ref = 'SAV_1' AND seq > 100",
    "replay_from_snapshot": _with(TXN) + "SELECT user_id, count(*) AS events, min(seq) AS first_seq, max(seq) AS last_seq FROM txn GROUP BY 1",
    "candidate_defaults": _with(TXN) + "SELECT user_id, seq, account_ref, CASE WHEN seq % 3 = 0 THEN 'savings' ELSE account_type END AS account_type, 'expense' AS transaction_type, amount_paise FROM txn",
    "active_keys": "SELECT user_id, max(user_id * 10 + n) AS key_id FROM (SELECT DISTINCT CAST(user_id AS BIGINT) AS user_id FROM events), (VALUES (0), (1), (2)) k(n) WHERE n <= user_id % 3 AND (user_id + n) % 4 <> 1 GROUP BY 1",
    "accounts_current": _with(CHANGES) + """SELECT account_id, arg_min(user_id, seq) FILTER (op = 'create') AS user_id, arg_min(account_ref, seq) FILTER (op = 'create') AS account_ref, arg_max(nickname, seq) FILTER (op <> 'deactivate' AND nickname IS NOT NULL) AS nickname,
  arg_max(account_type, seq) FILTER (op <> 'deactivate' AND account_type IS NOT NULL) AS account_type, arg_max(last4, seq) FILTER (op <> 'deactivate' AND last4 IS NOT NULL) AS last4,
  CASE WHEN bool_or(op = 'deactivate') THEN 'deactivated' ELSE 'pending' END AS sync_status FROM chg GROUP BY 1 HAVING bool_or(op = 'create')""",
    "account_requests": _with(CHANGES) + "SELECT seq, nullif(concat_ws(',', CASE WHEN nickname IS NULL OR length(nickname) NOT BETWEEN 1 AND 128 THEN 'nickname' END, CASE WHEN coalesce(account_type, 'loan') = 'loan' THEN 'account_type' END, CASE WHEN seq % 11 = 0 THEN 'last4' END), '') AS wrong FROM chg WHERE op = 'create'",
    "budget_outcomes": _with(LONG, BUDGETS) + "SELECT user_id, category, month, seq, op, code FROM bout",
    "budgets_current": _with(LONG, BUDGETS) + "SELECT user_id, category, month, arg_max(target_paise, seq) AS target_paise FROM bout WHERE code IS NULL GROUP BY 1, 2, 3 HAVING arg_max(op, seq) <> 'delete'",
    "budget_requests": _with(LONG) + f"SELECT seq, nullif(concat_ws(',', CASE WHEN NOT ({EXPENSES}) THEN 'category' END, CASE WHEN day(value_date) <> 1 THEN 'month' END, CASE WHEN amount_paise <= 0 THEN 'target_paise' END), '') AS wrong FROM lng",
    "balance_reports": _with(TXN, STATEMENTS, REPORTS) + """SELECT user_id, account_ref, account_type, code, CAST(CASE WHEN code IS NULL AND account_type <> 'credit_card' THEN total END AS BIGINT) AS derived_balance_paise,
  CAST(CASE WHEN code IS NULL AND account_type = 'credit_card' THEN -total END AS BIGINT) AS outstanding_liability_paise, CASE WHEN code IS NULL THEN period_end END AS anchor_period_end, CASE WHEN code IS NULL THEN false END AS is_stale FROM rb""",
    "resolver_decision_rows": _with(TXN, ID, cascade(), recursive=True) + f"""SELECT p.user_id, 'RESOLVER' AS account_ref, CAST(0 AS BIGINT) AS amount_paise, 'transfer' AS transaction_type, '' AS narration, a.value_date, a.sid AS ingestion_event_id,
  sha256(matched_by || ':' || least(a.idempotency_hash, b.idempotency_hash) || ':' || greatest(a.idempotency_hash, b.idempotency_hash)) AS idempotency_hash, matched_by AS event_type
  FROM pairs p JOIN (SELECT *, {WEEK} AS sid FROM ident) a ON a.seq = debit_seq JOIN ident b ON b.seq = credit_seq""",
    "category_corrections": _with(TXN, MERCHANTS, CORRECTIONS, LEARNED, CLASSIFIED) + "SELECT k.user_id, k.seq, k.txn, k.merchant, k.category, c.category AS prior_category, 'CategoryCorrected' AS event_type, CAST(k.user_id AS VARCHAR) AS corrected_by FROM corr k JOIN cls c ON c.user_id = k.user_id AND c.seq = k.txn",
    "category_lookup": _with(TXN, MERCHANTS, CORRECTIONS, LEARNED, CLASSIFIED) + "SELECT c.user_id, c.seq AS txn, coalesce(k.category, c.category) AS category, CASE WHEN coalesce(k.category, c.category) IS NULL THEN 'no_category_events' END AS error FROM cls c LEFT JOIN corr k ON k.user_id = c.user_id AND k.txn = c.seq",
    "nature_tag_corrected": _with(LONG, CORRECTED) + f"SELECT l.seq, CASE WHEN amount_paise < 0 THEN coalesce(mine, {NATURES_OF}) END AS nature, CASE WHEN amount_paise < 0 THEN coalesce('learned:' || CAST(txn AS VARCHAR), CASE WHEN {NATURES_OF} IS NOT NULL THEN 'rule:' || category END) END AS nature_rule, CASE WHEN amount_paise >= 0 THEN 'nature_on_non_expense' END AS error FROM lng l LEFT JOIN nat ON nat.txn = l.seq AND nat.user_id = l.user_id",
    "effective_nature": _with(LONG, CORRECTED) + f"SELECT user_id, txn, nature FROM (SELECT l.user_id, l.seq AS txn, coalesce(mine, CASE WHEN amount_paise < 0 THEN {NATURES_OF} END) AS nature FROM lng l LEFT JOIN nat ON nat.txn = l.seq AND nat.user_id = l.user_id) WHERE nature IS NOT NULL",
}
PRINTED = f"""prt AS (
  SELECT ingestion_event_id AS statement_id, user_id % 5 AS l, seq % 11 AS fault, CASE WHEN user_id % 5 = 4 THEN 'SLICE_SAV_' || right(lpad(CAST(user_id * 10 + CASE WHEN account_ref LIKE 'SAV%' THEN 1 WHEN account_ref LIKE 'CARD%' THEN 2 ELSE 3 END AS VARCHAR), 12, '0'), 4) ELSE account_ref || '_' || CAST(user_id AS VARCHAR) END AS account,
    ['hdfc_cc', 'sbi_cc', 'hdfc_savings', 'sbi_savings', 'slice_savings'][CAST(user_id % 5 + 1 AS INTEGER)] AS bank, period_start, period_end,
    opening_paise + CASE WHEN user_id % 5 >= 2 THEN 10000000000 ELSE 0 END AS opening, closing_paise + CASE WHEN user_id % 5 >= 2 THEN 10000000000 ELSE 0 END AS printed, row_count, net FROM st
), judged AS (
  SELECT *, CASE WHEN l IN (2, 3) THEN opening + net ELSE printed END AS closing, CASE WHEN fault = 5 THEN 'no layout fits' WHEN fault = 0 THEN 'no period' WHEN fault = 1 AND l <> 2 THEN 'no opening balance'
    WHEN fault = 2 AND l IN (0, 1, 4) THEN 'no closing balance' WHEN fault = 3 AND l = 3 THEN 'the last row has no balance' WHEN fault = 4 AND l = 3 THEN 'an amount doesn''t read' WHEN fault = 6 AND l = 4 THEN 'no account' END AS reason FROM prt
), prow AS (
  SELECT j.*, x.seq, x.value_date, x.amount_paise, trim(regexp_replace(x.narration, ' +', ' ', 'g')) || CASE WHEN l = 4 THEN CASE WHEN x.amount_paise > 0 THEN ' Credit' ELSE ' Debit' END ELSE '' END AS narr,
    row_number() OVER (PARTITION BY statement_id ORDER BY x.seq) - 1 AS place, CAST(opening + sum(x.amount_paise) OVER (PARTITION BY statement_id ORDER BY x.seq) AS BIGINT) AS balance
  FROM judged j JOIN (SELECT *, {WEEK} AS sid FROM txn) x ON x.sid = j.statement_id WHERE reason IS NULL
), pid AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY statement_id, value_date, amount_paise, upper(narr) ORDER BY place) - 1 AS INTEGER) AS occ FROM prow)"""
ORACLE |= {
    f"statement_rows_{name}": _with(TXN, STATEMENTS, PRINTED) + f"""SELECT statement_id, CAST(place AS INTEGER) AS pos, account AS account_ref, value_date, narr AS narration, amount_paise, CASE WHEN l >= 2 THEN balance END AS running_balance_paise, occ AS occurrence_index,
  sha256(account || '|' || strftime(value_date, '%Y-%m-%d') || '|' || CAST(amount_paise AS VARCHAR) || '|' || upper(narr) || '|' || CAST(occ AS VARCHAR)) AS idempotency_hash FROM pid WHERE l = {k}"""
    for k, name in enumerate(["hdfc_cc", "sbi_cc", "hdfc_savings", "sbi_savings", "slice_savings"])
} | {
    "statement_headers": _with(TXN, STATEMENTS, PRINTED) + """SELECT statement_id, CASE WHEN fault <> 5 THEN bank END AS layout, CASE WHEN fault <> 5 THEN CASE WHEN l < 2 THEN 'credit_card' ELSE 'savings' END END AS account_type,
  CASE WHEN reason IS NULL THEN account END AS account_ref, CASE WHEN reason IS NULL THEN period_start END AS period_start, CASE WHEN reason IS NULL THEN period_end END AS period_end,
  CASE WHEN reason IS NULL THEN opening END AS opening_paise, CASE WHEN reason IS NULL THEN closing END AS closing_paise, CASE WHEN reason IS NULL THEN 9000 END AS confidence,
  CASE WHEN reason IS NULL THEN row_count END AS row_count, CASE WHEN reason IS NULL THEN net END AS net_paise, CASE WHEN reason IS NULL THEN CASE WHEN opening + net = closing THEN 'pass' ELSE 'fail' END END AS balance_check, reason FROM judged""",
}
COMMITS = """mv AS (
  SELECT i.*, account_ref || '/' || CAST(user_id AS VARCHAR) || '/' || strftime(date_trunc('week', value_date), '%Y-%m-%d') || '/week' AS w,
    account_ref || '/' || CAST(user_id AS VARCHAR) || '/' || strftime(date_trunc('month', value_date), '%Y-%m-%d') || '/month' AS m FROM ident i
), firstw AS (
  SELECT w, user_id, count(*) AS n FROM mv GROUP BY 1, 2 HAVING max(seq) % 9 = 0
), known AS (
  SELECT seq FROM mv JOIN firstw USING (w) WHERE mv.user_id % 10 <> 7
), months AS (
  SELECT m, user_id, count(*) AS n, count(*) FILTER (seq IN (SELECT seq FROM known)) AS old FROM mv GROUP BY 1, 2)"""
RENUMBERED = """anew AS (
  SELECT mv.user_id, account_type, amount_paise, value_date, seq AS source, row_number() OVER (ORDER BY w, seq) AS seq, true AS early FROM mv JOIN firstw USING (w) WHERE mv.user_id % 10 <> 7
  UNION ALL SELECT user_id, account_type, amount_paise, value_date, seq, 1000000000000 + row_number() OVER (ORDER BY m, seq), false FROM mv WHERE user_id % 10 <> 7 AND seq NOT IN (SELECT seq FROM known)
), early AS (SELECT * FROM anew WHERE early)"""
_WEEKS = "SELECT w AS ingestion_event_id, user_id, CASE WHEN user_id % 10 = 7 THEN 'rejected' ELSE 'ingested' END AS status, CASE WHEN user_id % 10 = 7 THEN 0 ELSE n END AS records_added, CAST(0 AS BIGINT) AS records_skipped, CASE WHEN user_id % 10 = 7 THEN 0 ELSE n END AS in_log FROM firstw UNION ALL "
ORACLE |= {
    "commit_once_strict": _with(TXN, ID, COMMITS) + _WEEKS + "SELECT m, user_id, CASE WHEN user_id % 10 = 7 THEN 'rejected' WHEN old > 0 THEN 'duplicate' ELSE 'ingested' END, CASE WHEN user_id % 10 = 7 OR old > 0 THEN 0 ELSE n END, old, CASE WHEN user_id % 10 = 7 OR old > 0 THEN 0 ELSE n END FROM months",
    "commit_once_skipping": _with(TXN, ID, COMMITS) + _WEEKS + "SELECT m, user_id, CASE WHEN user_id % 10 = 7 THEN 'rejected' ELSE 'ingested' END, CASE WHEN user_id % 10 = 7 THEN 0 ELSE n - old END, old, CASE WHEN user_id % 10 = 7 THEN 0 ELSE n - old END FROM months",
}
_LATE = "late AS (SELECT * FROM anew WHERE (user_id, seq) NOT IN (SELECT (user_id, debit_seq) FROM pairs1 UNION ALL SELECT (user_id, credit_seq) FROM pairs1)), legs2 AS"
_PURSE = """purse AS (
  SELECT user_id, list_reduce(list(struct_pack(paise := amount_paise, spilled := CAST(0 AS BIGINT), short := CAST(0 AS BIGINT), events := CAST(1 AS BIGINT)) ORDER BY seq),
    lambda a, x: struct_pack(paise := CAST(least(50000, greatest(0, a.paise + x.paise)) AS BIGINT), spilled := CAST(a.spilled + greatest(0, a.paise + x.paise - 50000) AS BIGINT), short := CAST(a.short + greatest(0, -(a.paise + x.paise)) AS BIGINT), events := CAST(a.events + 1 AS BIGINT)),
    struct_pack(paise := CAST(0 AS BIGINT), spilled := CAST(0 AS BIGINT), short := CAST(0 AS BIGINT), events := CAST(0 AS BIGINT))) AS s, max(seq) AS last_seq
  FROM txn WHERE seq % 6 <> 5 GROUP BY user_id)"""
_FOLDED = _with(TXN, _PURSE) + "SELECT user_id, s.paise AS paise, s.spilled AS spilled, s.short AS short, s.events AS events, last_seq FROM purse"
_HALF = "(SELECT (min(seq) + max(seq)) // 2 FROM txn)"
ORACLE |= {
    "commit_resolves": _with(TXN, ID, COMMITS, RENUMBERED, cascade(source="early", n="1"), cascade(source="late", n="2").replace("legs2 AS", _LATE, 1), recursive=True)
    + "SELECT user_id, matched_by, count(*) AS pairs, count(*) AS debits, count(*) AS credits, CAST(sum(confidence) AS BIGINT) AS confidence FROM (SELECT * FROM pairs1 UNION ALL SELECT * FROM pairs2) GROUP BY 1, 2",
    "ordered_fold": _FOLDED,
    "snapshot_fallback": _FOLDED,
    "key_history": _with(TXN) + f"SELECT user_id, seq, user_id * 2 + CASE WHEN seq > {_HALF} THEN 1 ELSE 0 END AS key_id, seq > {_HALF} OR user_id % 3 <> 0 AS readable, CASE WHEN seq > {_HALF} OR user_id % 3 <> 0 THEN amount_paise END AS amount_paise FROM txn",
    "late_decryption": _with(TXN) + "SELECT user_id, account_ref AS aggregate_id, count(*) AS n, count(*) FILTER (user_id % 31 <> 0) AS readable, CAST(sum(amount_paise) FILTER (user_id % 31 <> 0) AS BIGINT) AS net_paise FROM txn WHERE account_ref LIKE 'SAV%' AND value_date < DATE '2024-01-16' GROUP BY 1, 2",
}


def _series(rows: str, spine: str, top: int = 10) -> str:
    return f"""base AS (
  SELECT user_id, category, amount_paise, 'Shop ' || CAST(seq % 23 AS VARCHAR) AS merchant, value_date FROM lng WHERE {rows}
), graind AS (
  SELECT *, 'month' AS grain, CAST(date_trunc('month', value_date) AS DATE) AS period FROM base
  UNION ALL SELECT *, 'quarter', CAST(date_trunc('quarter', value_date) AS DATE) FROM base
  UNION ALL SELECT *, 'fiscal_year', make_date(CAST(year(value_date) - CASE WHEN month(value_date) < 4 THEN 1 ELSE 0 END AS INTEGER), 4, 1) FROM base
), bounds AS ({spine}
), spine AS (
  SELECT user_id, grain, CAST(p AS DATE) AS period FROM bounds, LATERAL (SELECT unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), CASE grain WHEN 'month' THEN INTERVAL 1 MONTH WHEN 'quarter' THEN INTERVAL 3 MONTH ELSE INTERVAL 1 YEAR END)) AS p)
), whole AS (
  SELECT user_id, grain, period, coalesce(-sum(amount_paise) FILTER ({EXPENSES} OR (category IS NULL AND amount_paise < 0)), 0) AS expense, coalesce(sum(amount_paise) FILTER (category = 'income' AND amount_paise > 0), 0) AS income
  FROM spine LEFT JOIN graind USING (user_id, grain, period) GROUP BY 1, 2, 3
), cats AS (
  SELECT s.user_id, s.grain, s.period, k.category, coalesce(-sum(amount_paise), 0) AS spent FROM spine s JOIN (SELECT DISTINCT user_id, grain, category FROM graind WHERE {EXPENSES}) k USING (user_id, grain)
  LEFT JOIN graind g ON g.user_id = s.user_id AND g.grain = s.grain AND g.period = s.period AND g.category = k.category GROUP BY 1, 2, 3, 4
), nats AS (
  SELECT s.user_id, s.grain, s.period, k.n, coalesce(-sum(amount_paise) FILTER ({EXPENSES}), 0) AS spent FROM spine s JOIN (SELECT DISTINCT user_id, grain, {NATURES_OF} AS n FROM graind) k USING (user_id, grain)
  LEFT JOIN (SELECT *, {NATURES_OF} AS n FROM graind) g ON g.user_id = s.user_id AND g.grain = s.grain AND g.period = s.period AND g.n = k.n WHERE k.n IS NOT NULL GROUP BY 1, 2, 3, 4
), steady AS (
  SELECT user_id, grain, period, 'income_expense' AS series, 'income' AS key, income AS value FROM whole
  UNION ALL SELECT user_id, grain, period, 'income_expense', 'expense', expense FROM whole
  UNION ALL SELECT user_id, grain, period, 'net_cashflow', 'net', income - expense FROM whole
  UNION ALL SELECT user_id, grain, period, 'savings_rate', 'bps', CASE WHEN income > 0 THEN CAST(floor((income - expense)::DECIMAL(30, 4) * 10000 / income) AS BIGINT) END FROM whole
  UNION ALL SELECT user_id, grain, period, 'category_trend', category, spent FROM cats
  UNION ALL SELECT user_id, grain, period, 'category_split', category, CASE WHEN expense > 0 THEN CAST(floor(spent::DECIMAL(30, 4) * 10000 / expense) AS BIGINT) END FROM cats JOIN whole USING (user_id, grain, period)
  UNION ALL SELECT user_id, grain, period, 'nature_split', n, spent FROM nats
), lagged AS (
  SELECT *, lag(value) OVER (PARTITION BY user_id, grain, series, key ORDER BY period) AS previous FROM steady
), shops AS (
  SELECT user_id, grain, period, merchant, -sum(amount_paise) AS value, row_number() OVER (PARTITION BY user_id, grain, period ORDER BY -sum(amount_paise) DESC, merchant) AS place FROM graind GROUP BY 1, 2, 3, 4)"""


_SERIES = """SELECT user_id, grain, period, series, key, CAST(value AS BIGINT) AS value, CAST(previous AS BIGINT) AS previous, CAST(value - previous AS BIGINT) AS change, CAST(NULL AS INTEGER) AS place FROM lagged
  UNION ALL SELECT user_id, grain, period, 'top_merchants', merchant, CAST(value AS BIGINT), NULL, NULL, CAST(place AS INTEGER) FROM shops WHERE place <= %d"""
_OWN = "SELECT user_id, grain, min(period) AS a, max(period) AS b FROM graind GROUP BY 1, 2"
_CHOSEN = "SELECT DISTINCT user_id, grain, CASE grain WHEN 'month' THEN DATE '1995-02-01' WHEN 'quarter' THEN DATE '1995-01-01' ELSE DATE '1994-04-01' END AS a, CASE grain WHEN 'month' THEN DATE '1996-05-01' WHEN 'quarter' THEN DATE '1996-04-01' ELSE DATE '1996-04-01' END AS b FROM graind"
ORACLE |= {
    "dashboard_series": _with(LONG, _series("value_date IS NOT NULL", _OWN)) + _SERIES % 10,
    "dashboard_series_selected": _with(LONG, _series("value_date BETWEEN DATE '1995-02-10' AND DATE '1996-05-20'", _CHOSEN)) + _SERIES % 3,
    "pairings_with_periods": _with(TXN, ID, STATEMENTS, cascade(), recursive=True) + f"""SELECT p.user_id, matched_by, confidence, a.value_date, debit_seq, credit_seq,
  CASE matched_by WHEN 'transfer' THEN 'debit' WHEN 'reversal' THEN 'original' ELSE 'savings_debit' END AS first_role, a.idempotency_hash AS first_idempotency_hash, CASE WHEN s.seq IS NULL THEN '' ELSE a.account_ref END AS first_account_ref, s.period_start AS first_period_start, s.period_end AS first_period_end,
  CASE matched_by WHEN 'transfer' THEN 'credit' WHEN 'credit_card_payment' THEN 'cc_credit' WHEN 'fd_booking' THEN 'fd_credit' ELSE 'reversal' END AS second_role, b.idempotency_hash AS second_idempotency_hash, CASE WHEN t.seq IS NULL THEN '' ELSE b.account_ref END AS second_account_ref, t.period_start AS second_period_start, t.period_end AS second_period_end
  FROM pairs p JOIN (SELECT *, {WEEK} AS sid FROM ident) a ON a.seq = debit_seq JOIN (SELECT *, {WEEK} AS sid FROM ident) b ON b.seq = credit_seq
  LEFT JOIN (SELECT * FROM per WHERE seq % 7 <> 0) s ON s.ingestion_event_id = a.sid LEFT JOIN (SELECT * FROM per WHERE seq % 7 <> 0) t ON t.ingestion_event_id = b.sid""",
    "sync_report": _with(TXN, STATEMENTS, PRINTED) + """SELECT st.user_id, statement_id AS ingestion_event_id, account AS account_ref, bank AS layout, j.period_start, j.period_end, CASE WHEN opening + j.net = closing THEN 'ingested' ELSE 'rejected' END AS status, CASE WHEN opening + j.net = closing THEN j.row_count ELSE 0 END AS records_added,
  CAST(0 AS BIGINT) AS records_skipped, CASE WHEN opening + j.net = closing THEN 'pass' ELSE 'fail' END AS balance_check, 9000 AS confidence, st.seq * 13 % 80 > 35 AS is_stalled, 1 AS n FROM judged j JOIN st ON st.ingestion_event_id = j.statement_id WHERE reason IS NULL""",
    "overlap_pairs": _with(TXN, STATEMENTS) + """, months AS (
  SELECT account_ref || '/' || CAST(user_id AS VARCHAR) || '/' || strftime(date_trunc('month', value_date), '%Y-%m-%d') || '/month' AS ingestion_event_id, user_id, account_ref, CAST(date_trunc('month', value_date) AS DATE) AS period_start, last_day(min(value_date)) AS period_end FROM txn GROUP BY user_id, account_ref, date_trunc('month', value_date)
), every AS (SELECT ingestion_event_id, user_id, account_ref, period_start, period_end FROM per WHERE status <> 'rejected' UNION ALL SELECT * FROM months)
SELECT a.ingestion_event_id, b.ingestion_event_id AS other FROM every a JOIN every b ON a.user_id = b.user_id AND a.account_ref = b.account_ref AND a.ingestion_event_id <> b.ingestion_event_id AND a.period_start <= b.period_end AND b.period_start <= a.period_end""",
    "model_decisions": _with(TXN, MERCHANTS) + """, asked AS (SELECT *, CASE WHEN merchant IS NULL THEN upper(narration) || ' ' || CAST(seq % 211 AS VARCHAR) END AS text FROM named)
SELECT user_id, seq, CASE WHEN text IS NULL THEN merchant WHEN 6000 + 400 * (length(text) % 10) >= 7000 THEN upper(left(text, 1)) || lower(substr(split_part(text, ' ', 1), 2)) END AS merchant, CAST(CASE WHEN text IS NULL THEN 9500 ELSE 6000 + 400 * (length(text) % 10) END AS INTEGER) AS merchant_confidence,
  text IS NOT NULL AND 6000 + 400 * (length(text) % 10) < 7000 AS merchant_review, CASE WHEN text IS NOT NULL THEN CAST(1 AS BIGINT) END AS asked FROM asked""",
    "statement_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 9 THEN CASE WHEN o_orderkey % 4 = 3 THEN CAST(CAST(o_orderdate AS DATE) + INTERVAL 360 MONTH AS DATE) ELSE CAST(o_orderdate AS DATE) END END AS value_date FROM orders",
    "rupee_text": _with(LONG) + """, big AS (SELECT seq, amount_paise * (1 + seq % 997) AS p FROM lng), parts AS (SELECT seq, p, CAST(abs(p) // 100 AS VARCHAR) AS w, lpad(CAST(abs(p) % 100 AS VARCHAR), 2, '0') AS f FROM big)
SELECT seq, CASE WHEN p < 0 THEN '−' ELSE '' END || '₹' || CASE WHEN length(w) <= 3 THEN w ELSE regexp_replace(reverse(regexp_replace(reverse(w[1:length(w) - 3]), '([0-9]{2})', '\\1,', 'g')), '^,', '') || ',' || right(w, 3) END || '.' || f AS text FROM parts""",
    "budget_rows_once": _with(LONG, SPEND) + "SELECT user_id, category, month, spent_paise FROM spend",
    "split_checked": """WITH w AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS weight, CAST(round(o_totalprice * -100) AS BIGINT) AS total, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey) AS BIGINT) AS whole FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), r AS (SELECT *, (total * weight % whole + whole) % whole AS rest FROM w), b AS (SELECT *, (total * weight - rest) // whole AS base FROM r),
m AS (SELECT *, total - sum(base) OVER (PARTITION BY l_orderkey) AS missing, row_number() OVER (PARTITION BY l_orderkey ORDER BY rest DESC, l_linenumber, l_partkey, l_suppkey, weight) AS place FROM b)
SELECT l_orderkey, l_linenumber, base + CASE WHEN place <= missing THEN 1 ELSE 0 END AS share_paise FROM m""",
    "amount_types": _with(TXN) + "SELECT seq, CASE WHEN seq % 6 IN (0, 5) THEN amount_paise END AS amount_paise FROM txn",
}
ORACLE["resolver_streamed"] = ORACLE["resolver_incremental"]
ORACLE |= {
    "intake_statements": _with(TXN, STATEMENTS, PRINTED) + "SELECT statement_id, st.user_id, CASE WHEN reason IS NOT NULL THEN 'unread' WHEN opening + j.net = closing THEN 'ingested' ELSE 'rejected' END AS status, reason, CASE WHEN reason IS NULL AND opening + j.net = closing THEN j.row_count ELSE 0 END AS records_added, CASE WHEN reason IS NULL AND opening + j.net = closing THEN j.row_count ELSE 0 END AS in_log FROM judged j JOIN st ON st.ingestion_event_id = statement_id",
    "category_with_model": _with(TXN, MERCHANTS, CORRECTIONS, LEARNED, CLASSIFIED) + "SELECT user_id, seq, coalesce(category, CASE WHEN merchant IS NOT NULL THEN 'food_dining' END) AS category, category IS NULL AND merchant IS NULL AS category_review FROM cls",
}
