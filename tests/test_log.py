"""The log under crashes, repeated and simultaneous writers; snapshots, folds, keys, layouts and streamed state."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallowmere.operators import classify, ledger, resolve
from tallowmere.sources import commits, folders, folds, log, rendered, snapshots, statements, views

SF = "/root/testdata/sf0.001"
ROWS = "ingestion_event_id string, user_id bigint, source_seq bigint, account_type string, value_date date, amount_paise bigint, idempotency_hash string"
EVENTS = f"{ROWS}, seq bigint, bucket int"


def batch_of(spark, statement, hashes, check="pass", user=1):
    rows = spark.createDataFrame([(statement, user, k, "savings", None, 100 * (-1) ** k, h) for k, h in enumerate(hashes)], ROWS).withColumn("value_date", F.lit("2024-01-05").cast("date"))
    return spark.createDataFrame([(statement, user, check, "c" + statement)], "ingestion_event_id string, user_id bigint, balance_check string, content_hash string"), rows


def held(spark, path):
    return sorted(r.idempotency_hash for r in commits.committed(spark, path, "events", EVENTS).collect())


def statuses(spark, path):
    return {r.ingestion_event_id: (r.status, r.records_added, r.records_skipped) for r in commits.committed(spark, path, "statements", "ingestion_event_id string, status string, records_added bigint, records_skipped bigint").collect()}


@pytest.mark.parametrize("strict", [True, False])
def test_one_statement_twice_is_stored_once(spark, tmp_path, strict):
    path = str(tmp_path)
    assert commits.commit(*batch_of(spark, "a", ["h1", "h2"]), path, "one", strict) == 1
    assert commits.commit(*batch_of(spark, "a", ["h1", "h2"]), path, "one", strict) == 1
    assert commits.commit(*batch_of(spark, "b", ["h1", "h2", "h3"]), path, "two", strict) == 2
    assert commits.commit(*batch_of(spark, "c", ["h9"], "fail"), path, "three", strict) == 3
    assert held(spark, path) == (["h1", "h2"] if strict else ["h1", "h2", "h3"])
    assert statuses(spark, path) == {"a": ("ingested", 2, 0), "b": ("duplicate", 0, 2) if strict else ("ingested", 1, 2), "c": ("rejected", 0, 0)}
    pairs = commits.committed(spark, path, "decisions", commits.PAIR).collect()
    assert len(pairs) == 1


def test_a_writer_that_dies_leaves_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    commits.commit(*batch_of(spark, "a", ["h1"]), path, "one")
    with monkeypatch.context() as m:
        m.setattr(folders, "put_if_absent", lambda *a: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError, match="died"):
            commits.commit(*batch_of(spark, "b", ["h2"]), path, "two")
    assert held(spark, path) == ["h1"] and len(folders.names(spark, f"{path}/events")) == 2
    folders.put_if_absent(spark, f"{path}/markers/{2:020d}", "")  # one that died while it wrote its marker
    assert commits.commit(*batch_of(spark, "b", ["h2"]), path, "two") == 3
    assert held(spark, path) == ["h1", "h2"]


def test_writers_at_the_same_time(spark, tmp_path, monkeypatch):
    path, real, calls = str(tmp_path), folders.put_if_absent, []

    def put(*args):
        if not calls:
            calls.append(1)
            commits.commit(*batch_of(spark, "other", ["h1", "h5"]), path, "other")
        return real(*args)

    monkeypatch.setattr(folders, "put_if_absent", put)
    assert commits.commit(*batch_of(spark, "mine", ["h1", "h2"]), path, "mine") == 2
    assert held(spark, path) == ["h1", "h5"]
    assert statuses(spark, path) == {"other": ("ingested", 2, 0), "mine": ("duplicate", 0, 1)}


def test_rows_of_a_batch_with_one_hash_and_without(spark, tmp_path):
    a, b = batch_of(spark, "a", ["h1", "h1"]), batch_of(spark, "b", ["h1", "h2"])
    both = [x.unionByName(y) for x, y in zip(a, b)]
    commits.commit(*both, str(tmp_path / "x"), "one", strict=False)
    assert held(spark, str(tmp_path / "x")) == ["h1", "h2"]
    commits.commit(*both, str(tmp_path / "y"), "one", strict=True)
    assert statuses(spark, str(tmp_path / "y"))["b"] == ("duplicate", 0, 1)
    with pytest.raises(ValueError, match="no user or hash"):
        commits.commit(*batch_of(spark, "a", ["h1", None]), str(tmp_path / "z"), "one")
    heads, rows = batch_of(spark, "a", ["h1"])
    assert commits.commit(heads.limit(0), rows.limit(0), str(tmp_path / "w"), "none") == 1 and held(spark, str(tmp_path / "w")) == []


def events_of(spark, rows):
    return spark.createDataFrame([(u, s, k, 2, "a", p) for u, s, k, p in rows], "user_id bigint, seq bigint, event_type string, event_version int, aggregate_id string, payload string")


def test_fold_steps_in_order_and_passes_over_unknown_types(spark):
    amounts = [70_000, -10_000, -60_000, 5_000]
    rows = [(u, s, "TransactionIngested", json.dumps({"amount_paise": a})) for u in (1, 2) for s, a in enumerate(amounts)] + [(1, 9, "Unheard", "not json"), (3, 1, "TransactionIngested", None)]
    out = {r.user_id: (json.loads(r.state), r.last_seq) for r in folds.fold(events_of(spark, rows).repartition(3), "purse").collect()}
    assert out[1] == out[2] == ({"paise": 5_000, "spilled": 20_000, "short": 20_000, "events": 4}, 3)
    assert out[3][0]["events"] == 1
    with pytest.raises(ValueError, match="unknown projection"):
        folds.fold(events_of(spark, rows), "nobody")
    assert folds.fold(events_of(spark, rows).limit(0), "purse").count() == 0


def test_snapshots_written_broken_read_and_rebuilt(spark, tmp_path):
    path, rows = str(tmp_path), [(u, s, "TransactionIngested", json.dumps({"amount_paise": (s * 7919 % 90_000) - 40_000})) for u in range(4) for s in range(60)]
    events = events_of(spark, rows)
    whole = sorted(map(tuple, folds.fold(events, "purse").collect()))
    assert snapshots.newest(spark, path, "purse") is None
    assert sorted(map(tuple, snapshots.current(events, path, "purse", "purse").collect())) == whole
    names = [snapshots.save(folds.fold(events.where(F.col("seq") <= n), "purse"), path, "purse", n) for n in (10, 30, 50)]
    assert snapshots.newest(spark, path, "purse")[1] == 50
    (tmp_path / "purse" / "rows" / names[2] / "_SUCCESS").unlink()
    assert snapshots.newest(spark, path, "purse")[1] == 30
    for part in (tmp_path / "purse" / "rows" / names[1]).glob("part-*"):
        part.write_bytes(b"broken")
    assert snapshots.newest(spark, path, "purse")[1] == 10
    assert sorted(map(tuple, snapshots.current(events, path, "purse", "purse").collect())) == whole
    first = min((tmp_path / "purse" / "manifests").glob("0*"))
    (tmp_path / "purse" / "manifests" / f".{first.name}.crc").unlink()
    first.write_text("{")
    assert snapshots.newest(spark, path, "purse") is None
    assert sorted(map(tuple, snapshots.current(events, path, "purse", "purse").collect())) == whole


def test_keys_by_id_and_none_active(spark):
    events = events_of(spark, [(1, 1, "TransactionIngested", "{}")])
    keys = spark.createDataFrame([(5, 1, bytes(32), 0, None), (6, 1, bytes([1]) * 32, 1, None)], "key_id bigint, user_id bigint, key binary, created_at int, deactivated_at int")
    sealed = log.seal_by_key(events, keys)
    assert [r.key_id for r in sealed.collect()] == [6]
    gone = log.shredded(keys, F.col("key_id") == 6, F.lit(2))
    assert [r.payload for r in log.open_by_key(sealed, gone).collect()] == [None]
    assert [r.payload for r in log.open_by_key(sealed, log.shredded(keys, F.col("key_id") == 5, F.lit(2))).collect()] == ["{}"]
    assert [r.key_id for r in log.seal_by_key(events, gone).collect()] == [5]
    with pytest.raises(PySparkException, match="no active key"):
        log.seal_by_key(events, log.shredded(keys, F.lit(True), F.lit(2))).collect()


def test_payloads_are_opened_after_rows_are_picked(spark):
    sealed = spark.createDataFrame([], "user_id bigint, seq bigint, aggregate_id string, payload binary, key_id bigint").repartition(2)
    keys = spark.createDataFrame([], "key_id bigint, key binary")
    plan = log.open_by_key(sealed, keys).where("aggregate_id LIKE 'SAV%'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("aesDecrypt") < plan.index("Join") < plan.index("StartsWith")  # the plan's first lines run last


def test_weights_that_fit_no_split(spark):
    for weights in ([0, 0], [1, -1], [None, 1]):
        rows = spark.createDataFrame([(1, 100, k, w) for k, w in enumerate(weights)], "key int, total bigint, place int, weight bigint")
        with pytest.raises(PySparkException, match="weight"):
            log.fit_to_split(rows, "key").collect()


def test_interval_joins_equal_all_pairs(spark):
    import random
    from datetime import date, timedelta

    r = random.Random(4)
    day = lambda k: date(2020, 1, 1) + timedelta(k)
    periods = []
    for k in range(150):
        start = r.randint(-400, 400)
        periods.append((f"s{k}", 1, f"a{k % 3}", r.choice([None, day(start)]) if k % 20 == 0 else day(start), day(start + r.choice([0, 1, 6, 40, 300])), "rejected" if k % 17 == 0 else "ingested"))
    df = spark.createDataFrame(periods, "ingestion_event_id string, user_id bigint, account_ref string, period_start date, period_end date, status string")
    fine = [p for p in periods if p[5] != "rejected" and p[3]]
    want = {(a[0], b[0]) for a in fine for b in fine if a[0] != b[0] and a[2] == b[2] and a[3] <= b[4] and b[3] <= a[4]}
    assert sorted(map(tuple, ledger.overlap_pairs(df).collect())) == sorted(want)
    rows = [(1, k, f"a{k % 4}", day(r.randint(-450, 800)) if k % 9 else None) for k in range(200)]
    out = {x.seq: x.covering_count for x in ledger.covering(spark.createDataFrame(rows, "user_id bigint, seq bigint, account_ref string, value_date date"), df).collect()}
    assert out == {k: sum(d is not None and a == p[2] and p[3] <= d <= p[4] for p in fine) for _, k, a, d in rows}


def test_a_layout_of_ones_own_and_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one two.txt").write_text("My Bank\nAccount: X_1\nStatement Period: 01/02/2024 to 29/02/2024\nPrevious Balance: 1,000.00 Dr\nNew Balance: 900.00 cr\n")
    texts = statements.texts_of(spark, str(tmp_path / "t"))
    cells = spark.createDataFrame([("one two", 0, 1, ["03/02/2024", "Shop", "12.50 Dr"])], statements.UNITS["cells"])
    words = spark.createDataFrame([], statements.UNITS["words"])
    mine = statements.Layout("mine", "credit_card", ("my bank",), (), "cells", statements.sbi_card, statements.card_header)
    heads, rows = statements.read(texts, cells, words, [*statements.LAYOUTS, mine])
    h = heads.first()
    assert (h.statement_id, h.layout, h.account_ref, h.opening_paise, h.closing_paise, h.net_paise, h.balance_check) == ("one two", "mine", "X_1", -100000, 90000, -1250, "fail")
    assert [(r.narration, r.amount_paise) for r in rows.collect()] == [("Shop", -1250)]
    assert [r.reason for r in statements.read(texts, cells, words)[0].collect()] == [statements.NO_LAYOUT]


def test_model_answers_are_asked_for_once(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def model(texts):
        asked.add(len(texts))
        return [(t.upper(), 7000 if t < "m" else 6999) for t in texts]

    rows = spark.createDataFrame([(k, "known" if k == 0 else None, t) for k, t in enumerate(["x", "a", "a", "b", "z", None])], "k int, merchant string, text string")
    answers = str(tmp_path / "answers")
    for _ in range(2):
        stored = spark.read.schema(classify.ANSWER).parquet(answers) if folders.exists(spark, answers) else spark.createDataFrame([], classify.ANSWER)
        classify.ask_once(rows.where("merchant IS NULL"), stored, model, "merchant", "v1").write.mode("append").parquet(answers)
    assert asked.value == 3
    out = {r.k: (r.merchant, r.merchant_review) for r in classify.with_answers(rows, spark.read.parquet(answers), "text", "merchant", "merchant", "v1", 7000).collect()}
    assert out == {0: ("known", False), 1: ("A", False), 2: ("A", False), 3: ("B", False), 4: (None, True), 5: (None, True)}
    assert classify.ask_once(rows, spark.read.parquet(answers), model, "merchant", "v2").count() == 4


def test_a_batch_in_the_log_is_not_read_again(spark, tmp_path):
    heads, rows = batch_of(spark, "a", ["h1"])
    assert commits.commit(heads, rows, str(tmp_path), "one") == 1
    broken = rows.withColumn("idempotency_hash", F.raise_error(F.lit("read")).cast("string"))
    assert commits.commit(heads, broken, str(tmp_path), "one") == 1


def test_texts_of_statements_are_searched_once(spark):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        asked.add(1)
        return text

    texts = spark.createDataFrame([(str(k), "Slice Small Finance Bank") for k in range(3)], statements.UNITS["texts"])
    heads, _ = statements.read(texts.withColumn("text", counted("text")), *(spark.createDataFrame([], statements.UNITS[u]) for u in ("cells", "words")))
    assert heads.count() == heads.where("reason = 'no account'").count() == 3
    assert asked.value <= 6  # for the headers, and for rows that are lines of the text


def test_keyed_state_equals_the_incremental_resolver(spark, tmp_path):
    from tallowmere.streaming import keyed

    txn = views.ledger_txn(spark, SF).select("user_id", "seq", "account_type", "amount_paise", "value_date").orderBy("seq")
    rows = [tuple(r) for r in txn.collect()]
    schema, source, decided, seen = txn.schema, str(tmp_path / "in"), None, []
    for k in range(5):
        part = rows[k * 200 : (k + 1) * 200]
        new = spark.createDataFrame(part + (part[:20] if k % 2 else []) + (rows[:30] if k == 3 else []), schema)
        new.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        keyed.start(spark, stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()  # each turn is a restart
        so_far, before = spark.createDataFrame(rows[: (k + 1) * 200], schema), seen[-1] if seen else -1
        fresh = resolve.resolve_new(so_far, decided if decided is not None else spark.createDataFrame([], keyed_schema()), before)
        decided = spark.createDataFrame([tuple(r) for r in (fresh if decided is None else decided.unionByName(fresh)).collect()], keyed_schema())
        seen.append(part[-1][1])
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(decided.columns).collect())) == sorted(map(tuple, decided.collect()))
    assert decided.count() > 100


def test_open_legs_of_a_key_are_one_value(spark, tmp_path):
    from tallowmere.streaming import keyed

    rows = spark.sql("SELECT 1L AS user_id, id AS seq, 'savings' AS account_type, -100L AS amount_paise, DATE'2024-01-05' AS value_date FROM range(5)")
    rows.write.parquet(str(tmp_path / "in"))
    run = keyed.start(spark, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    run.awaitTermination()
    held = [op["numRowsTotal"] for p in run.recentProgress for op in p["stateOperators"] if op["operatorName"].startswith("transformWithState")]
    assert held and max(held) == 1


def keyed_schema():
    return "user_id bigint, debit_seq bigint, credit_seq bigint, matched_by string, confidence int"


def test_printed_statements_hold_every_fault(spark):
    heads, rows = rendered.printed(views.ledger_txn(spark, "/root/testdata/sf0.01"))
    found = {r.reason for r in statements.headers(rendered.texts(heads, rows)).select("reason").distinct().collect()}
    assert found >= {None, statements.NO_LAYOUT, *statements.ABSENT.values()}
