"""The resolver with keyed state: open legs by user and amount, held by the stream itself.

A key's state holds the legs that no decision has claimed. A batch's new legs come in, the cascade runs over the
open ones, and what it pairs leaves them: the same decisions as the resolver over the stored log gives, which reads
no log here. A leg that came before, by its number, is dropped by the stream's own state of numbers, before the
legs' state is asked; so repeated rows do no harm, also in a batch that is run again from its checkpoint. Open legs
grow with what stays unpaired of one user and amount; a key's are one value, read and written once a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallowmere.operators.resolve import MATCHERS, paired, score_sql

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OPEN = "seqs array<bigint>, kinds array<string>, days array<int>, debits array<boolean>"


class OpenLegs(StatefulProcessor):
    """Legs of one user and amount that are still open, in order of their numbers."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", OPEN)

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        held = self.open.get()
        legs = sorted([*(zip(*held) if held else ()), *((r.seq, r.account_type, r.day, r.is_debit) for r in rows)])
        found = list(paired([x[:3] for x in legs if x[3]], [x[:3] for x in legs if not x[3]], MATCHERS))
        claimed = {seq for debit, credit, _, _ in found for seq in (debit, credit)}
        still = [x for x in legs if x[0] not in claimed]
        if still:
            self.open.update(tuple(map(list, zip(*still))))
        elif held:
            self.open.clear()
        for pair in found:
            yield Row(user_id=key[0], debit_seq=pair[0], credit_seq=pair[1], matched_by=pair[2], gap=pair[3])

    def close(self) -> None:
        pass


def decisions(rows: DataFrame) -> DataFrame:
    """Pairs of streaming `rows` (user_id, seq, account_type, amount_paise, value_date), each as soon as both legs are there."""
    legs = rows.where("amount_paise <> 0").dropna(subset=["user_id", "seq", "account_type", "value_date"])
    legs = legs.select(F.col("user_id").cast("long").alias("user_id"), F.abs("amount_paise").alias("size"), F.col("seq").cast("long").alias("seq"), "account_type", F.unix_date("value_date").alias("day"), F.expr("amount_paise < 0").alias("is_debit"))
    legs = legs.dropDuplicates(["user_id", "size", "seq"])
    out = legs.groupBy("user_id", "size").transformWithState(OpenLegs(), "user_id long, debit_seq long, credit_seq long, matched_by string, gap int", "Append", "None")
    return out.select("user_id", "debit_seq", "credit_seq", "matched_by", F.expr(score_sql("gap")).cast("int").alias("confidence"))


def start(spark: SparkSession, rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the decisions to a table at `path`, once each, over what is there now; a restart goes on from `checkpoint`."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return decisions(rows).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
