"""Streams equal their batch forms, and a restart adds nothing."""

import datetime
import json

from ledgerloom.operators import messages as msg
from ledgerloom.schema import CASH_STORAGE
from ledgerloom.sources.ledger import LedgerStore, TableStore
from ledgerloom.streaming import ingest, messages

USERS = {1: "ann"}


def _lines(*texts, start=1):
    return "\n".join(
        json.dumps({"update_id": start + i, "sent_at": "2024-01-05T10:00:00.000Z", "user_id": 1, "chat_id": 9, "text": t})
        for i, t in enumerate(texts)
    )


def test_cash_stream_undo_over_batches(spark, tmp_path):
    inbox, store = tmp_path / "in", TableStore(spark, str(tmp_path / "store"))
    inbox.mkdir()

    def run():
        stream = messages.read_messages(spark, str(inbox))
        messages.cash_stream(stream, store, str(tmp_path / "ck"), 9, USERS, []).awaitTermination()

    (inbox / "1.json").write_text(_lines("Coffee 10", "Tea 20"))
    run()
    (inbox / "2.json").write_text(_lines("/undo", "Cake 30", "hello there", start=3))
    run()
    run()
    messages.flush_pending(store, [])
    rows = store.read("cash", CASH_STORAGE).collect()
    assert sorted((r.Description, r.Debit) for r in rows) == [("Cake", "30.00"), ("Coffee", "10.00")]
    everything = spark.read.schema(messages.CASH_MESSAGE).json(str(inbox))
    batch = msg.apply_undo(msg.cash_events(msg.authorised(everything, 9, USERS)))
    assert batch.count() == len(rows)


def test_ingest_stream_restart_and_late_rows(spark, tmp_path):
    inbox, store = tmp_path / "in", LedgerStore(spark, str(tmp_path / "store"))
    schema = "txn_date date, account string, description string, amount decimal(18,2)"

    def drop(name, *rows):
        spark.createDataFrame([(datetime.date(2024, 1, d), a, t, x) for d, a, t, x in rows], schema).coalesce(1).write.mode("append").parquet(str(inbox))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(inbox))
        ingest.ingest_stream(stream, store, str(tmp_path / "ck"), [{"category": "Food", "description": ["cafe"]}]).awaitTermination()

    from decimal import Decimal as D

    drop("1", (5, "bank-a", "cafe one", D("-1.00")), (6, "cc-b", "shop", D("-2.00")))
    run()
    drop("2", (5, "bank-a", "too late", D("-9.00")), (7, "bank-a", "cafe two", D("-3.00")))
    run()
    run()
    rows = sorted((r.description, r.category) for r in store.read_all().collect())
    assert rows == [("cafe one", "Food"), ("cafe two", "Food"), ("shop", "Uncategorized")]
    late = ingest.late_rows(
        spark.createDataFrame([(datetime.date(2024, 1, 2), "bank-a", "x", D("1.00"))], schema),
        spark.createDataFrame([("bank-a", datetime.date(2024, 1, 7))], "account string, latest date"),
    )
    assert late.count() == 1
