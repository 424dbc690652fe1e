"""Sessions, commits, requests, current rows, natures and the log's numbers on small inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallowmere.functions import columns as c
from tallowmere.operators import classify, entities, identity
from tallowmere.sources import log, staging

AT = dt.datetime(2024, 2, 1, 10, 0)
SESSION = "session_id string, user_id bigint, account_ref string, account_type string, period_start date, period_end date, opening_paise bigint, closing_paise bigint, balance_check string, confidence int, content_hash string, created_at timestamp"


def sessions(spark, *checks):
    day = AT.date()
    rows = [(f"s{i}", 1, "SAV_1", "savings", day, day, 0, 5, check, 9500, "h", AT) for i, check in enumerate(checks)]
    return staging.with_expiry(spark.createDataFrame(rows, SESSION))


def test_sessions_run_out_and_end(spark):
    s = sessions(spark, "pass", "pass")
    at = lambda seconds: F.lit(AT + dt.timedelta(seconds=seconds))
    assert staging.live(s, at(3599)).count() == 2
    assert staging.live(s, at(3600)).count() == 0
    ended = spark.createDataFrame([("s0",), ("s0",), ("other",)], "session_id string")
    assert [r.session_id for r in staging.live(s, at(0), ended).collect()] == ["s1"]


def test_commit_again_and_without_marker(spark, tmp_path):
    s = sessions(spark, "pass", "fail", None, "not_applicable")
    rows = spark.createDataFrame([("s0", 5), ("s1", 7), ("s2", 9)], "session_id string, amount_paise bigint")
    batch = staging.confirm(s, rows)
    for _ in range(2):
        staging.commit(batch, str(tmp_path), "2024")
    batch["events"].write.parquet(f"{tmp_path}/events/batch=2025")
    assert [(r.ingestion_event_id, r.amount_paise) for r in staging.committed(spark, str(tmp_path), "events").collect()] == [("s0", 5)]
    got = {r.ingestion_event_id: (r.status, r.records_added) for r in staging.committed(spark, str(tmp_path), "statements").collect()}
    assert got == {"s0": ("ingested", 1), "s1": ("rejected", 0), "s2": ("rejected", 0), "s3": ("ingested", 0)}
    assert {r.ingestion_event_id for r in batch["artifacts"].where("retained").collect()} == {"s1", "s2"}


def test_numbers_rise_and_need_a_hash(spark):
    rows = spark.createDataFrame([(k, "h") for k in range(100)], "k bigint, idempotency_hash string")
    got = [r.seq for r in log.numbered(rows, 41, ["k"]).orderBy("k").collect()]
    assert got == sorted(set(got)) and got[0] > 41
    with pytest.raises(Exception, match="no idempotency_hash"):
        log.numbered(rows.withColumn("idempotency_hash", F.lit(None).cast("string")), 0, ["k"]).collect()


def test_snapshot_and_tail_make_the_whole(spark, tmp_path):
    events = spark.createDataFrame([(k % 3, k) for k in range(50)], "user_id bigint, seq bigint")
    log.snapshot(log.events_list(events.where("seq <= 30")), str(tmp_path), "events_list", 30)
    state = log.latest_snapshot(spark, str(tmp_path), "events_list")
    out = log.replay(state.drop("up_to"), events, state.first()["up_to"]).orderBy("user_id").collect()
    assert out == log.events_list(events).orderBy("user_id").collect()


def test_budget_changes(spark):
    day = dt.date(2024, 1, 1)
    ops = [("patch", 9), ("create", 1), ("create", 2), ("patch", 3), ("delete", None), ("delete", None), ("create", 4)]
    changes = spark.createDataFrame([(1, "rent_housing", day, t, op, i) for i, (op, t) in enumerate(ops)], "user_id bigint, category string, month date, target_paise bigint, op string, seq bigint")
    codes = [r.code for r in entities.budget_outcomes(changes).orderBy("seq").collect()]
    assert codes == ["not_found", None, "budget_duplicate", None, None, "not_found", None]
    assert [r.target_paise for r in entities.budgets(changes).collect()] == [4]
    assert [r.target_paise for r in entities.budgets(changes.where("seq < 4")).collect()] == [3]
    assert entities.budgets(changes.where("seq < 5")).count() == entities.budgets(changes.limit(0)).count() == 0


def test_natures(spark):
    rows = spark.createDataFrame([(1, 1, "travel", "m", "expense"), (1, 2, "other", None, "expense"), (1, 3, "travel", "m", "income"), (1, 4, None, None, "expense"), (1, 5, "travel", "m", None)], "user_id bigint, txn bigint, category string, merchant string, transaction_type string")
    corrections = spark.createDataFrame([(1, 1, "discretionary", 1), (1, 1, "essential_fixed", 2), (2, 2, "luxury", 3)], "user_id bigint, txn bigint, nature string, seq bigint")
    got = {r.txn: (r.nature, r.nature_rule, r.error) for r in classify.tag_nature(rows, corrections).collect()}
    wrong = (None, None, "nature_on_non_expense")
    assert got == {1: ("essential_fixed", "learned:1", None), 2: (None, None, None), 3: wrong, 4: (None, None, None), 5: wrong}
    asked = classify.tag_nature(rows, corrections, classify.stub_model("luxury", 7500)).collect()
    assert {r.txn for r in asked if r.nature == "luxury"} == {2, 4}
    assert classify.tag_nature(rows, corrections, classify.stub_model("luxury", 7499)).where("nature = 'luxury'").count() == 0


def test_narrations_beyond_ascii(spark):
    rows = spark.createDataFrame([(1, " a  b"), (2, "ﬁn　é "), (3, None)], "seq bigint, narration string")
    got = {r.seq: r.canonical_narration for r in identity.with_canonical(rows).collect()}
    assert got == {1: "A B", 2: "FIN É", 3: None}


def test_money_as_text(spark):
    rows = spark.createDataFrame([("9007199254740993",), ("-5",), ("1.5",), ("",), (None,)], "t string")
    assert [r.x for r in rows.select(c.money_of_text(F.col("t")).alias("x")).collect()] == [9007199254740993, -5, None, None, None]
