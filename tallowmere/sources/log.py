"""The append-only event log: events, upcasting, sealed payloads, snapshots; and exact splits of amounts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallowmere.sources import folders

VERSION = 2
#: (event type, from version) -> payload of the next version.
UPCASTERS: dict[tuple[str, int], Callable[[Column], Column]] = {}
#: Projections by name: events -> view.
REDUCERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_upcaster(kind: str, version: int):
    def add(f):
        UPCASTERS[kind, version] = f
        return f

    return add


def register_reducer(name: str):
    def add(f):
        REDUCERS[name] = f
        return f

    return add


@register_upcaster("TransactionIngested", 1)
def _named_narration(payload: Column) -> Column:
    """Version 1 called the narration `text`."""
    return F.regexp_replace(payload, '"text":', '"narration":')


def as_events(rows: DataFrame, old: Column | None = None) -> DataFrame:
    """Ledger rows as ingestion events; `old` rows in version 1."""
    old = F.lit(False) if old is None else old
    new = F.to_json(F.struct("narration", "amount_paise", "account_ref", "account_type"))
    before = F.to_json(F.struct(F.col("narration").alias("text"), "amount_paise", "account_ref", "account_type"))
    return rows.select("user_id", "seq", F.lit("TransactionIngested").alias("event_type"), F.when(old, 1).otherwise(VERSION).alias("event_version"), F.col("account_ref").alias("aggregate_id"), F.when(old, before).otherwise(new).alias("payload"))


def field(name: str, kind: str = "string") -> Column:
    return F.get_json_object("payload", f"$.{name}").cast(kind).alias(name)


def whole_number(payload: Column, name: str) -> Column:
    """A field that is a whole number in the JSON text itself; null for texts, fractions, truth values and absent ones."""
    bare = F.regexp_extract(payload, rf'"{name}"\s*:\s*(-?[0-9]+)\s*[,}}]', 1)
    return F.when(bare != "", bare.try_cast("bigint"))


def upcast(events: DataFrame) -> DataFrame:
    """Every payload brought up, version by version, as far as the chain of its type reaches."""
    for version in range(1, VERSION):
        for (kind, at), step in sorted(UPCASTERS.items()):
            if at == version:
                mine = (F.col("event_type") == kind) & (F.col("event_version") == version)
                events = events.withColumns({"payload": F.when(mine, step(F.col("payload"))).otherwise(F.col("payload")), "event_version": F.when(mine, version + 1).otherwise(F.col("event_version"))})
    return events


@register_reducer("events_list")
def events_list(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.count("*").alias("events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def seal(events: DataFrame, keys: DataFrame) -> DataFrame:
    """Payloads encrypted (AES-GCM) with each user's active key."""
    return events.join(keys, "user_id").withColumn("payload", F.aes_encrypt("payload", "key", F.lit("GCM"))).drop("key")


def unseal(events: DataFrame, keys: DataFrame) -> DataFrame:
    """Payloads decrypted; null, not an error, where a user's key is gone or wrong."""
    return events.join(keys, "user_id", "left").withColumn("payload", F.try_aes_decrypt("payload", "key", F.lit("GCM")).cast("string")).drop("key")


def seal_by_key(events: DataFrame, keys: DataFrame) -> DataFrame:
    """Payloads encrypted with each user's active key, and its key_id. A user without one is an error.

    `keys`: key_id, user_id, key (null once shredded), created_at, deactivated_at. The newest key that isn't deactivated
    is active; one row a user is joined.
    """
    active = keys.where("deactivated_at IS NULL AND key IS NOT NULL").groupBy("user_id").agg(F.max_by(F.struct("key_id", "key"), F.struct("created_at", "key_id")).alias("k"))
    out = events.join(active, "user_id", "left")
    lost = F.raise_error(F.concat(F.lit("no active key of user "), F.col("user_id").cast("string"))).cast("string")
    return out.withColumns({"payload": F.aes_encrypt("payload", F.when(F.col("k").isNotNull(), F.col("k.key")).otherwise(lost), F.lit("GCM")), "key_id": F.col("k.key_id")}).drop("k")


def open_by_key(events: DataFrame, keys: DataFrame) -> DataFrame:
    """Payloads decrypted with the key that each event names, whichever is active now; null where that one is shredded or unknown.

    Filters on other columns, put before or after this, come before the decryption: it works on rows that are left.
    """
    own = keys.groupBy("key_id").agg(F.first("key", ignorenulls=True).alias("_key"))
    return events.join(own, "key_id", "left").withColumn("payload", F.try_aes_decrypt("payload", "_key", F.lit("GCM")).cast("string")).drop("_key")


def shredded(keys: DataFrame, which: Column, at: Column) -> DataFrame:
    """Keys of which those that `which` picks are deactivated and their material gone, for good."""
    return keys.withColumns({"key": F.when(~which, F.col("key")), "deactivated_at": F.when(which, F.coalesce("deactivated_at", at)).otherwise(F.col("deactivated_at"))})


def numbered(rows: DataFrame, last_seq: int, order: list[str]) -> DataFrame:
    """New rows with `seq` after `last_seq`, rising in `order`, with gaps; a row without a hash ends the job.

    Numbers come from ranges of `order`, so no task sorts all rows of a user.
    """
    hashed = F.when(F.col("idempotency_hash").isNotNull(), F.col("idempotency_hash")).otherwise(F.raise_error(F.lit("a row has no idempotency_hash")))
    out = rows.withColumn("idempotency_hash", hashed).repartitionByRange(*order).sortWithinPartitions(*order)
    return out.withColumn("seq", F.lit(last_seq + 1) + F.monotonically_increasing_id())


def stream(events: DataFrame, account_ref: str | None = None, since: int = -1) -> DataFrame:
    """One account's events (all accounts': none given) after `since`, in order for each user."""
    mine = events.where(F.col("seq") > since)
    return mine if account_ref is None else mine.where(F.col("aggregate_id") == account_ref)


def replay(state: DataFrame, events: DataFrame, since: int) -> DataFrame:
    """`events_list` of a snapshot taken at `since` and the events after it, without reading the earlier ones again."""
    both = state.unionByName(events_list(events.where(F.col("seq") > since)))
    return both.groupBy("user_id").agg(F.sum("events").alias("events"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))


def candidates(events: DataFrame) -> DataFrame:
    """Typed rows from upcast events: an absent account type is savings, an absent account the event's own, an absent type expense."""
    return upcast(events).select(
        "user_id", "seq",
        F.coalesce(F.get_json_object("payload", "$.account_ref"), "aggregate_id").alias("account_ref"),
        F.coalesce(F.get_json_object("payload", "$.account_type"), F.lit("savings")).alias("account_type"),
        F.coalesce(F.get_json_object("payload", "$.transaction_type"), F.lit("expense")).alias("transaction_type"),
        field("narration"), field("amount_paise", "bigint"),
    )


def append(events: DataFrame, path: str) -> None:
    """Appends to the log; nothing here rewrites it."""
    events.withColumn("bucket", F.pmod(F.hash("user_id"), F.lit(64))).write.mode("append").partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str, since: int = -1) -> DataFrame:
    return spark.read.parquet(path).where(F.col("seq") > since).drop("bucket")


def snapshot(view: DataFrame, path: str, name: str, last_seq: int) -> None:
    view.write.parquet(f"{path}/{name}/up_to={last_seq}")


def latest_snapshot(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """The rows of the newest snapshot, with `up_to`, the last event in it; None before the first. `snapshots` checks them too."""
    found = [int(n.removeprefix("up_to=")) for n in folders.names(spark, f"{path}/{name}") if n.startswith("up_to=")]
    if not found:
        return None
    return spark.read.parquet(f"{path}/{name}/up_to={max(found)}").withColumn("up_to", F.lit(max(found)))


def fit_to_split(rows: DataFrame, key: str) -> DataFrame:
    """`rows`, an error where a weight is missing or negative or all weights of a key are zero."""
    whole = F.sum("weight").over(W.partitionBy(key))
    wrong = F.when(F.coalesce(F.col("weight"), F.lit(-1)) < 0, "a weight is negative").when(F.col("_whole") <= 0, "no weight is positive")
    out = rows.withColumn("_whole", whole)
    return out.where(F.when(wrong.isNull(), True).otherwise(F.raise_error(wrong).cast("boolean"))).drop("_whole")


def split_by_weight(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """share_paise: `total` split by `weight` within `key`, exactly; the largest remainders get what rounding down leaves."""
    whole = F.sum("weight").over(W.partitionBy(key))
    rows = rows.where("weight >= 0").withColumn("whole", whole).where("whole > 0")
    product = F.col("total") * F.col("weight")
    rows = rows.withColumn("rest", F.pmod(product, F.col("whole"))).withColumn("base", F.expr("(total * weight - rest) div whole"))
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc("rest"), *order))
    missing = F.col("total") - F.sum("base").over(W.partitionBy(key))
    return rows.withColumn("share_paise", F.col("base") + F.when(place <= missing, 1).otherwise(0))
