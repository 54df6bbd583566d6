"""The keyed form of undo equals the batch form over any split into micro-batches."""

import json
import random
import time

from ledgerloom.operators import messages as msg
from ledgerloom.schema import CASH_MESSAGE, CASH_STORAGE
from ledgerloom.sources.ledger import TableStore
from ledgerloom.streaming import undo

USERS = {1: "ann", 2: "bo"}


def lines(rows):
    return "\n".join(
        json.dumps({"update_id": u, "sent_at": "2024-01-05T10:00:00.000Z", "user_id": 1 + u % 2, "chat_id": c, "text": t}) for u, c, t in rows
    )


def test_keyed_undo_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    texts = ["Coffee 10", "/undo", "hello", "+5 atm", "/undo", "Tea 3.50 2024-01-02"]
    rows = [(u, rng.choice([9, 9, 9, 10]), rng.choice(texts)) for u in range(1, 60)]
    cuts = sorted(rng.sample(range(1, len(rows)), 2))
    inbox = tmp_path / "in"
    inbox.mkdir()
    undo.use_rocksdb(spark)

    def events(frame):
        return msg.cash_events(msg.authorised(frame, 9, USERS).unionByName(msg.authorised(frame, 10, USERS)))

    def run(wait):
        stream = undo.standing_entries(events(spark.readStream.schema(CASH_MESSAGE).json(str(inbox))), wait)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
        query.trigger(once=True).start().awaitTermination()

    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        part = rows[a:b] + (rows[a - 2 : a] if a else [])  # some are delivered twice
        rng.shuffle(part)
        (inbox / f"{n}.json").write_text(lines(part))
        run(3600)
    everything = spark.read.schema(CASH_MESSAGE).json(str(inbox)).dropDuplicates(["update_id"])
    wanted = {r.update_id: r.amount for r in msg.apply_undo(events(everything)).collect()}
    last = {}
    for u, c, t in rows:
        if t != "hello":
            last[c] = u
    found = [(r.update_id, r.amount) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(found) == sorted((u, a) for u, a in wanted.items() if u not in last.values())
    # The last entry of a chat waits for its timer, here one second; a later undo leaves it.
    (inbox / "z1.json").write_text(lines([(100, 9, "Cake 7")]))
    run(1)
    time.sleep(2)
    (inbox / "z2.json").write_text(lines([(101, 10, "hello")]))
    run(1)
    (inbox / "z3.json").write_text(lines([(102, 9, "/undo"), (103, 9, "Pie 8"), (104, 9, "/undo")]))
    run(1)
    found = {r.update_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert 100 in found and not found & {101, 102, 103, 104}


def test_keyed_stream_books_what_stands(spark, tmp_path):
    inbox, store = tmp_path / "in", TableStore(spark, str(tmp_path / "store"))
    inbox.mkdir()
    (inbox / "1.json").write_text(lines([(1, 9, "Coffee 10"), (2, 9, "Tea 20"), (3, 9, "/undo"), (4, 9, "Cake 30")]))
    stream = spark.readStream.schema(CASH_MESSAGE).json(str(inbox))
    undo.keyed_cash_stream(stream, store, str(tmp_path / "ck"), 9, USERS, [], trigger={"once": True}).awaitTermination()
    assert [(r.Description, r.Debit) for r in store.read("cash", CASH_STORAGE).collect()] == [("Coffee", "10.00")]
