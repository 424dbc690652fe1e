"""The resolver: pairs debits with credits that offset them, greedily and in order of priority.

Only rows of equal size pair, and a row is claimed once, so the cascade of matchers falls apart by user and
absolute amount; further by islands of dates, since no pair spans more than the accepted gap. One shuffle
brings rows of a user and amount together by date; each task streams through them and folds an island when it
is over. Who is claimed depends on who was before, by `seq` and not by date, so this fold is plain code; it
takes a step for each row, kind of account and day of the accepted gap, however long the island is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_DAYS, BASE, SAME_DAY, PER_DAY, LEAST = 3, 9000, 500, 200, 8500
REACH = min(WINDOW_DAYS, (BASE - LEAST) // PER_DAY)
#: Matchers by priority: (name, whether an account type of the debit and one of the credit fit).
MATCHERS: list[tuple[str, Callable[[str, str], bool]]] = [
    ("transfer", lambda debit, credit: debit == credit == "savings"),
    ("credit_card_payment", lambda debit, credit: (debit, credit) == ("savings", "credit_card")),
    ("fd_booking", lambda debit, credit: (debit, credit) == ("savings", "fd")),
    ("reversal", lambda debit, credit: debit == credit),
]


def score_sql(gap: str) -> str:
    """Confidence of a pair of equal size, in basis points, from its gap in days."""
    return f"CASE WHEN {gap} > {WINDOW_DAYS} THEN 0 WHEN {gap} = 0 THEN {BASE + SAME_DAY} ELSE greatest(0, {BASE} - {PER_DAY} * {gap}) END"


def paired(debits: list[tuple], credits: list[tuple], matchers: list) -> Iterator[tuple]:
    """(debit, credit, matcher, gap in days) of legs (seq, account type, day) of one size.

    Each matcher takes the debits that are left in order of seq, and gives each the free credit with the smallest
    seq that fits and is near enough.
    """
    free: dict[tuple, list] = {}
    for seq, kind, day in sorted(set(credits), reverse=True):
        free.setdefault((kind, day), []).append(seq)  # the smallest last
    kinds, left = {kind for kind, _ in free}, sorted(set(debits))
    for name, fits in matchers:
        still = []
        for seq, kind, day in left:
            near = ((other, day + step) for other in kinds if fits(kind, other) for step in range(-REACH, REACH + 1))
            credit, at = min(((free[k][-1], k) for k in near if free.get(k)), default=(None, None))
            if at is None:
                still.append((seq, kind, day))
            else:
                yield seq, free[at].pop(), name, abs(day - at[1])
        left = still


def _starts(rows: pa.RecordBatch | pa.Table, before: tuple | None) -> tuple[np.ndarray, tuple]:
    """Where islands begin in rows sorted by user, size and day, given the row before them; and the last row."""
    user, size, day = (rows[c].to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows[c].to_numpy() for c in ["user_id", "size", "day"])
    new = np.r_[True, (user[1:] != user[:-1]) | (size[1:] != size[:-1]) | (day[1:] - day[:-1] > REACH)]
    new[0] = before is None or before[:2] != (user[0], size[0]) or day[0] - before[2] > REACH
    return np.flatnonzero(new), (user[-1], size[-1], day[-1])


def resolve(candidates: DataFrame, matchers: list[tuple[str, Callable[[str, str], bool]]] | None = None) -> DataFrame:
    """user_id, debit_seq, credit_seq, matched_by, confidence of every pair among (user_id, seq, account_type, amount_paise, value_date) rows.

    Rows with a null in one of these, and amounts of zero, pair with nothing; repeated rows count once.
    """
    matchers = matchers or MATCHERS

    def islands(rows: pa.Table) -> pa.RecordBatch:
        starts, _ = _starts(rows, None)
        ends, debit = np.r_[starts[1:], rows.num_rows], rows["is_debit"].to_numpy()
        debits = np.add.reduceat(debit.astype(np.int64), starts)
        found, at = [], []
        for k in np.flatnonzero((debits > 0) & (debits < ends - starts)):
            part = rows.slice(starts[k], ends[k] - starts[k])
            legs = list(zip(*(part[c].to_pylist() for c in ["seq", "account_type", "day", "is_debit"])))
            pairs = list(paired([x[:3] for x in legs if x[3]], [x[:3] for x in legs if not x[3]], matchers))
            found += pairs
            at += [starts[k]] * len(pairs)
        columns = list(zip(*found)) or [[], [], [], []]
        users = rows["user_id"].take(pa.array(at, pa.int64())).combine_chunks()
        kinds = [rows.schema.field("seq").type, rows.schema.field("seq").type, pa.string(), pa.int32()]
        return pa.RecordBatch.from_arrays([users, *(pa.array(c, t) for c, t in zip(columns, kinds))], ["user_id", "debit_seq", "credit_seq", "matched_by", "gap"])

    def fold(batches):
        held, last = [], None  # the island that isn't over yet
        for b in batches:
            if not b.num_rows:
                continue
            starts, last = _starts(b, last)
            if len(starts):
                whole = [*held, b.slice(0, starts[-1])]
                if sum(w.num_rows for w in whole):
                    yield islands(pa.Table.from_batches(whole))
                held = []
            held.append(b.slice(starts[-1] if len(starts) else 0))
        if held:
            yield islands(pa.Table.from_batches(held))

    named = {f.name: f.dataType.simpleString() for f in candidates.schema}
    rows = candidates.where("amount_paise <> 0").dropna(subset=["user_id", "seq", "account_type", "value_date"])
    rows = rows.select("user_id", F.abs("amount_paise").alias("size"), F.unix_date("value_date").alias("day"), "seq", "account_type", F.expr("amount_paise < 0").alias("is_debit"))
    rows = rows.repartition("user_id", "size").sortWithinPartitions("user_id", "size", "day")
    out = rows.mapInArrow(fold, f"user_id {named['user_id']}, debit_seq {named['seq']}, credit_seq {named['seq']}, matched_by string, gap int")
    return out.select("user_id", "debit_seq", "credit_seq", "matched_by", F.expr(score_sql("gap")).cast("int").alias("confidence"))


def decision_hash(kind: Column, a: Column, b: Column) -> Column:
    """Identity of a decision: the same whichever leg comes first."""
    return F.sha2(F.concat_ws(":", kind, F.least(a, b), F.greatest(a, b)), 256)


def decisions(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs as decision records with the hashes of their legs; `rows` has idempotency_hash by (user_id, seq)."""
    debit = rows.select("user_id", F.col("seq").alias("debit_seq"), F.col("idempotency_hash").alias("debit_hash"), "value_date", *[c for c in ["ingestion_event_id"] if c in rows.columns])
    credit = rows.select("user_id", F.col("seq").alias("credit_seq"), F.col("idempotency_hash").alias("credit_hash"))
    out = pairs.join(debit, ["user_id", "debit_seq"]).join(credit, ["user_id", "credit_seq"])
    return out.withColumn("decision_hash", decision_hash(F.col("matched_by"), F.col("debit_hash"), F.col("credit_hash")))


def decision_rows(decided: DataFrame) -> DataFrame:
    """Decisions as rows of the log: on no account, without an amount, dated and sourced as their first leg.

    `decided`: `decisions` of rows that carry ingestion_event_id.
    """
    return decided.select("user_id", F.lit("RESOLVER").alias("account_ref"), F.lit(0).cast("bigint").alias("amount_paise"), F.lit("transfer").alias("transaction_type"), F.lit("").alias("narration"), "value_date", "ingestion_event_id", F.col("decision_hash").alias("idempotency_hash"), F.col("matched_by").alias("event_type"), "debit_hash", "credit_hash", "confidence")


def undecided(candidates: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows that no decision has claimed."""
    claimed = decided.select("user_id", F.col("debit_seq").alias("seq")).unionByName(decided.select("user_id", F.col("credit_seq").alias("seq")))
    return candidates.join(claimed, ["user_id", "seq"], "left_anti")


def resolve_new(candidates: DataFrame, decided: DataFrame, since: int) -> DataFrame:
    """Pairs that rows after `since` make possible, given the pairs already decided, which stay as they are.

    Only groups of user and size that new rows touch are looked at.
    """
    touched = candidates.where(F.col("seq") > since).select("user_id", F.abs("amount_paise").alias("size")).distinct()
    open_ = candidates.withColumn("size", F.abs("amount_paise")).join(touched, ["user_id", "size"], "left_semi").drop("size")
    return resolve(undecided(open_, decided))


def exclusions(pairs: DataFrame) -> DataFrame:
    """(user_id, seq, reason) of both legs of each pair; of several decisions on a leg the last counts."""
    legs = pairs.select("user_id", "debit_seq", "matched_by", F.greatest("debit_seq", "credit_seq").alias("at"), F.explode(F.array("debit_seq", "credit_seq")).alias("seq"))
    return legs.groupBy("user_id", "seq").agg(F.max_by("matched_by", F.struct("at", "debit_seq")).alias("reason"))
