"""T6 as keyed state: one waiting event per chat, settled by the next one or by a timer."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerloom.operators import messages as msg
from ledgerloom.schema import AMOUNT
from ledgerloom.sources.ledger import TableStore
from ledgerloom.streaming.messages import CashBooks

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAIT_SECONDS = 3600

# What is kept of an event: enough to book an entry, or to know that it was an undo.
EVENT = T.StructType(
    [
        T.StructField("chat_id", T.LongType()),
        T.StructField("update_id", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("txn_date", T.DateType()),
        T.StructField("description", T.StringType()),
        T.StructField("amount", AMOUNT),
        T.StructField("is_credit", T.BooleanType()),
    ]
)


class _LastEvent(StatefulProcessor):
    """Emits an entry once the chat's next event is not an undo, or nothing came in time."""

    def __init__(self, wait_seconds: int) -> None:
        self.wait_seconds = wait_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", EVENT)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        names = EVENT.fieldNames()
        waiting = Row(**dict(zip(names, self.last.get(), strict=True))) if self.last.exists() else None
        seen = waiting.update_id if waiting else None
        for event in sorted(rows, key=lambda r: r.update_id):
            if seen is not None and event.update_id <= seen:
                continue  # delivered before
            if waiting is not None and waiting.kind == "entry" and event.kind != "undo":
                yield waiting
            waiting = seen_event = Row(**{n: event[n] for n in names})
            seen = seen_event.update_id
        if waiting is not None:
            self.last.update(tuple(waiting[n] for n in names))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if waiting.kind == "entry":
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_seconds * 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        names = EVENT.fieldNames()
        waiting = dict(zip(names, self.last.get(), strict=True))
        if waiting["kind"] == "entry":
            # It stands from now on; its number stays, so that a repeated delivery is known.
            self.last.update(tuple("booked" if n == "kind" else waiting[n] for n in names))
            yield Row(**waiting)

    def close(self) -> None:
        pass


def standing_entries(events: DataFrame, wait_seconds: int = WAIT_SECONDS) -> DataFrame:
    """T6 over a stream of ``cash_events``: the entries that stand, each once.

    An entry goes iff the chat's next event is an undo. The last event of each chat is
    state; an entry waits there for ``wait_seconds`` at most. Events arrive in the order of
    their update ids, within a batch in any order; a repeated one is passed over. Needs the
    RocksDB state store (``use_rocksdb``). Timers ask for one batch after another, so the
    query runs on a processing-time trigger; ``availableNow`` would not come to an end.
    """
    return (
        events.select(*EVENT.fieldNames())
        .groupBy("chat_id")
        .transformWithState(_LastEvent(wait_seconds), EVENT, outputMode="Append", timeMode="ProcessingTime")
    )


def keyed_cash_stream(
    messages: DataFrame, store: TableStore, checkpoint: str, chat_id: int, users: dict[int, str],
    matchers: Sequence[dict], wait_seconds: int = WAIT_SECONDS, trigger: dict | None = None,
) -> StreamingQuery:
    """T5 / T6 / N8 with the waiting entries as state: each is booked when it stands.

    The replay of a batch adds nothing: rows carry their update id. ``trigger`` defaults to
    a batch a minute.
    """
    use_rocksdb(messages.sparkSession)
    entries = standing_entries(msg.cash_events(msg.authorised(messages, chat_id, users)), wait_seconds)

    def apply(batch: DataFrame, _: int) -> None:
        CashBooks(store, matchers).open().book(batch)

    return (
        entries.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that keyed state with timers needs, where another one is set."""
    if "RocksDB" not in (spark.conf.get(STATE_STORE, "") or ""):
        spark.conf.set(STATE_STORE, ROCKSDB)
