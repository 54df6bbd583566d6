"""Cash messages as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators import messages as msg
from ledgerloom.operators.category_index import query_keys
from ledgerloom.operators.index_store import IndexStore
from ledgerloom.plans.jobs import label_cash
from ledgerloom.schema import CASH_MESSAGE, CASH_STORAGE
from ledgerloom.sources.ledger import TableStore, cash_history

# The last event of a chat, which a later undo may still take back.
PENDING = T.StructType(
    [
        *CASH_MESSAGE.fields,
        T.StructField("label", T.StringType()),
    ]
)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a folder of JSON lines; the query's checkpoint is the read offset."""
    return spark.readStream.schema(CASH_MESSAGE).json(path)


def settle(batch: DataFrame, pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T6 over batches: (entries that can no longer be undone, each chat's last event).

    The event that was last before is put in front of the batch, so an undo reaches it;
    the newest event of each chat waits. Undo of a settled entry has no effect, as only
    the event directly before an undo goes.
    """
    events = pending.unionByName(batch.select(*PENDING.fieldNames())).dropDuplicates(["chat_id", "update_id"])
    marked = msg.cash_events(events)
    last = marked.groupBy("chat_id").agg(F.max("update_id").alias("_last"))
    kept = msg.apply_undo(marked).join(last, "chat_id").filter(F.col("update_id") < F.col("_last")).drop("_last")
    newest = marked.join(last, "chat_id").filter(F.col("update_id") == F.col("_last"))
    return kept, newest.select(*PENDING.fieldNames())


CASH = T.StructType([*CASH_STORAGE.fields, T.StructField("update_id", T.LongType())])
STATE = T.StructType([T.StructField("booked", T.LongType())])


class CashBooks:
    """The cash ledger with its stored category index; each staged batch is booked once."""

    def __init__(self, store: TableStore, matchers: Sequence[dict]) -> None:
        self.store, self.matchers, self.index = store, matchers, IndexStore(store, "cash-index", "global")

    def open(self) -> CashBooks:
        """Finishes a batch whose booking was cut short; the first time, indexes what is stored."""
        staged, state = self.store.generation("cash-batch"), self.store.read("cash-books", STATE).first()
        if state is None or not self.index.exists():
            self.index.rebuild(cash_history(self.store.read("cash", CASH)), staged)
            self._save(staged)
        elif state.booked < staged:
            self._book(staged)
        return self

    def _save(self, booked: int) -> None:
        self.store.replace("cash-books", self.store.spark.createDataFrame([(booked,)], STATE))

    def _book(self, number: int) -> None:
        rows, known = self.store.read("cash-batch", CASH), self.store.read("cash", CASH)
        self.store.append("cash", rows.join(known.select("update_id"), "update_id", "left_anti").select(*CASH.fieldNames()))
        self.index.append(cash_history(rows), number)
        self._save(number)

    def book(self, entries: DataFrame) -> None:
        """Labels entries the ledger does not hold by the index as it stands, and books them."""
        known = self.store.read("cash", CASH)
        new = msg.cash_transactions(entries).join(known.select("update_id"), "update_id", "left_anti")
        new = self.store.rewrite("cash-new", new)
        if new.isEmpty():
            return
        rows = label_cash(new, known.drop("update_id"), self.matchers, "update_id", index=self.index.load(query_keys(new)))
        self.store.replace("cash-batch", self.store.rewrite("cash-labelled", rows.select(*CASH.fieldNames())))
        self._book(self.store.generation("cash-batch"))


def cash_stream(
    messages: DataFrame, store: TableStore, checkpoint: str, chat_id: int, users: dict[int, str],
    matchers: Sequence[dict], trigger: dict | None = None,
) -> StreamingQuery:
    """Cash rows of the messages that stand, appended batch by batch.

    ``trigger`` defaults to ``availableNow``. A replayed batch adds nothing: rows carry
    the message's update id, and those the store holds are left out.
    """

    def apply(batch: DataFrame, _: int) -> None:
        books = CashBooks(store, matchers).open()
        settled, newest = settle(msg.authorised(batch, chat_id, users), store.read("cash-pending", PENDING))
        newest = store.rewrite("cash-newest", newest)
        books.book(settled)
        store.replace("cash-pending", newest)

    return (
        messages.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def flush_pending(store: TableStore, matchers: Sequence[dict]) -> None:
    """Books the entries still waiting for an undo, once a chat is closed."""
    waiting = msg.cash_events(store.read("cash-pending", PENDING)).filter("kind = 'entry'")
    CashBooks(store, matchers).open().book(waiting)
    store.replace("cash-pending", store.spark.createDataFrame([], PENDING))
