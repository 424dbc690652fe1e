"""Projections that step through a user's events in order: a registry of first states and steps, and the fold.

A projection is for what joins and windows can't say, where each state hangs on the one before. Events are dealt
by user, sorted, and streamed; a task holds one user's state at a time, however many events the user has.
Types of events that a projection doesn't know are passed over; a projection that nobody registered is an error.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowmere.sources.log import upcast

#: Type of the row that brings a state into a fold, before the user's events.
STATE = "_state"


@dataclass(frozen=True)
class Projection:
    """`initial` makes a state, `steps` change it by type of event: (state, seq, payload) -> state. States are JSON objects."""

    initial: Callable[[], dict]
    steps: dict[str, Callable[[dict, int, dict], dict]]


PROJECTIONS: dict[str, Projection] = {}


def register(name: str, initial: Callable[[], dict]) -> Projection:
    """A projection of that name, to which `step` adds types of events. One of that name is replaced."""
    PROJECTIONS[name] = Projection(initial, {})
    return PROJECTIONS[name]


def step(projection: Projection, kind: str):
    def add(f):
        projection.steps[kind] = f
        return f

    return add


def fold(events: DataFrame, name: str, states: DataFrame | None = None) -> DataFrame:
    """(user_id, state, last_seq) of each user: the registered steps over the events (user_id, seq, event_type, payload) in order.

    `states`: what an earlier fold gave; its users go on from there with events after their last_seq. Events are
    brought up to their last version first. A null payload is an empty object; repeated rows count each.
    """
    if name not in PROJECTIONS:
        raise ValueError(f"unknown projection: {name!r}")
    projection = PROJECTIONS[name]
    rows = upcast(events).where(F.col("event_type").isin(list(projection.steps))).select("user_id", "seq", "event_type", "payload")
    if states is not None:
        rows = rows.join(states.select("user_id", F.col("last_seq").alias("_upto")), "user_id", "left").where("_upto IS NULL OR seq > _upto").drop("_upto")
        rows = rows.unionByName(states.select("user_id", F.col("last_seq").alias("seq"), F.lit(STATE).alias("event_type"), F.col("state").alias("payload")))
    kind = events.schema["user_id"].dataType.simpleString()

    def run(batches):
        user = state = last = None
        for b in batches:
            done = []
            for u, seq, event, payload in zip(*(b.column(c).to_pylist() for c in ("user_id", "seq", "event_type", "payload"))):
                if state is None or u != user:
                    if state is not None:
                        done.append((user, json.dumps(state, sort_keys=True), last))
                    user, state = u, projection.initial()
                payload = json.loads(payload) if payload else {}
                state, last = payload if event == STATE else projection.steps[event](state, seq, payload), seq
            yield out(done, b.schema.field("user_id").type)
        if state is not None:
            yield out([(user, json.dumps(state, sort_keys=True), last)], b.schema.field("user_id").type)

    def out(rows, kind):
        columns = zip(*rows) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, pa.string(), pa.int64()])], ["user_id", "state", "last_seq"])

    first = F.when(F.col("event_type") == STATE, 0).otherwise(1)
    dealt = rows.withColumn("_first", first).repartition("user_id").sortWithinPartitions("user_id", "_first", "seq").drop("_first")
    return dealt.mapInArrow(run, f"user_id {kind}, state string, last_seq long")


#: A purse that is never below nothing nor above this many paise.
PURSE_LIMIT = 50_000
PURSE = register("purse", lambda: {"paise": 0, "spilled": 0, "short": 0, "events": 0})


@step(PURSE, "TransactionIngested")
def _purse(state: dict, seq: int, payload: dict) -> dict:
    """What doesn't fit is spilled, what isn't there is short."""
    paise = state["paise"] + int(payload.get("amount_paise") or 0)
    return {"paise": min(PURSE_LIMIT, max(0, paise)), "spilled": state["spilled"] + max(0, paise - PURSE_LIMIT), "short": state["short"] + max(0, -paise), "events": state["events"] + 1}
