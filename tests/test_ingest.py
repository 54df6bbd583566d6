"""Incremental ingest: golden ledgers, statement stream, index deltas, extracted statements, recovery."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import category_index
from ledgerloom.operators.categorize import LOW_CONFIDENCE_REMARK, REVIEW_REMARK
from ledgerloom.operators.index_store import IndexStore
from ledgerloom.plans import jobs
from ledgerloom.plans.booking import LABEL_CACHE, Books
from ledgerloom.schema import REVIEW, TXN
from ledgerloom.sources.ledger import LedgerStore, TableStore, VerificationFailed, verify_rows
from ledgerloom.sources.rules import parsing_configs
from ledgerloom.streaming import ingest

CONFIGS = {
    "bank-north": {
        "header_patterns": [["Posted", "CHQ", "NARRATION", "OUT", "IN", "BAL"]],
        "column_map": {"Posted": "date", "NARRATION": "description", "OUT": "debit", "IN": "credit"},
        "date_formats": ["%d-%m-%Y"],
        "statement_period_patterns": [r"from (\d{2}) (?P<start>\S+) until (?P<end>\d{2}-\d{2}-\d{4})"],
    },
    "cc-south": {
        "header_patterns": [["Day", "Details", "Amount", "Debit/Credit"]],
        "column_map": {"Day": "date", "Details": "description", "Amount": "amount", "Debit/Credit": "type"},
        "date_formats": ["%d/%m/%Y", "%d %b %y"],
        "amount_sign_col": "type",
        "debit_value": "Debit",
        "statement_period_patterns": [r"(?P<start>\d{2}/\d{2}/\d{4}) - (?P<end>\d{2}/\d{2}/\d{4})"],
    },
}
MATCHERS = [
    {"category": "Travel", "debit": True, "description": ["ferry"]},
    {"category": "Dining", "debit": True, "description": ["bistro"]},
    {"category": "Transfer:Cash", "debit": True, "description": ["cash point"]},
]
BANK = """Posted,CHQ,NARRATION,OUT,IN,BAL
05-05-2025,,STREAMBOX MONTHLY 8888,64.00,,
06-05-2025,,ferry to the isle,20.00,,
07-05-2025,,HARBOUR STONE CONSULTING RETAINER PAYOUT,,7500.00,
08-05-2025,,nameless vendor 4042,99.00,,
09-05-2025,,cash point 12,50.00,,
"""
CARD = """Day,Details,Amount,Debit/Credit
12 May 25,TUNEBOX PREMIUM 9921,11.90,Debit
13 May 25,corner bistro,145.00,Debit
14 May 25,dim billing co,77.70,Debit
"""
BEFORE = [
    ("2025-04-01", "STREAMBOX MONTHLY 4499", "-64.00", "Subscriptions", "bank-north-main"),
    ("2025-04-02", "STREAMBOX MONTHLY 1102", "-64.00", "Subscriptions", "bank-north-main"),
    ("2025-04-03", "HARBOUR STONE CONSULTING RETAINER", "7500.00", "Consulting", "bank-north-main"),
    ("2025-04-04", "HARBOUR STONE CONSULTING RETAINER", "7500.00", "Consulting", "bank-north-main"),
    ("2025-04-05", "HARBOUR STONE CONSULTING RETAINER", "7500.00", "Consulting", "bank-north-main"),
    ("2025-04-10", "TUNEBOX PREMIUM 7781", "-11.90", "Subscriptions", "cc-south-gold"),
]
ADDED = {
    ("STREAMBOX MONTHLY 8888", "-64.00", "Subscriptions", ""),
    ("ferry to the isle", "-20.00", "Travel", ""),
    ("HARBOUR STONE CONSULTING RETAINER PAYOUT", "7500.00", "Consulting", LOW_CONFIDENCE_REMARK),
    ("nameless vendor 4042", "-99.00", "Uncategorized", REVIEW_REMARK),
    ("cash point 12", "-50.00", "Transfer:Cash", ""),
    ("TUNEBOX PREMIUM 9921", "-11.90", "Subscriptions", ""),
    ("corner bistro", "-145.00", "Dining", ""),
    ("dim billing co", "-77.70", "Uncategorized", REVIEW_REMARK),
}
AS_OF = "2025-06-30"


def rules(spark):
    accounts = spark.createDataFrame(
        [("bank", "bank-north-main", 0), ("cc", "cc-south-gold", 0)], "kind string, account string, idx int"
    )
    return jobs.Rules(accounts, parsing_configs(spark, CONFIGS), MATCHERS, mirror={"Transfer:Cash": "in"})


def txns(spark, rows):
    made = [(datetime.date.fromisoformat(d), t, Decimal(a), c, "", n) for d, t, a, c, n in rows]
    return spark.createDataFrame(made, TXN)


def new_store(spark, tmp_path, name="store"):
    store = LedgerStore(spark, str(tmp_path / name))
    history = txns(spark, BEFORE)
    for kind in ("bank", "cc"):
        store.append_ledger(kind, history.filter(F.col("account").startswith(kind)))
    return store


def inbox(tmp_path, **files):
    folder = tmp_path / "inbox"
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / f"{name.replace('_', '-')}.csv").write_text(text)
    return folder


def added(store):
    old = {r[1] for r in BEFORE}
    return sorted((r.description, str(r.amount), r.category, r.remarks) for r in store.read_all().collect() if r.description not in old)


def test_golden_layers_and_second_run(spark, tmp_path):
    folder = inbox(tmp_path, bank_north_main_2025_05=BANK, cc_south_gold_2025_05=CARD)
    store = new_store(spark, tmp_path)
    counts = {(r.ledger, r.source): r.rows for r in jobs.incremental_ingest(spark, store, str(folder), rules(spark), AS_OF).collect()}
    assert set(added(store)) == ADDED and len(added(store)) == len(ADDED)
    assert counts == {
        ("bank", "exact"): 1, ("bank", "rule"): 2, ("bank", "fuzzy"): 1, ("bank", "default"): 1,
        ("cc", "exact"): 1, ("cc", "rule"): 1, ("cc", "default"): 1,
    }
    assert store.read("cash", jobs.CASH_STORAGE).count() == 1
    again = jobs.incremental_ingest(spark, store, str(folder), rules(spark), AS_OF)
    assert again.count() == 0 and len(added(store)) == len(ADDED)
    assert store.read("cash", jobs.CASH_STORAGE).count() == 1


def test_statement_stream_equals_the_run(spark, tmp_path):
    folder = inbox(tmp_path, bank_north_main_2025_05=BANK, cc_south_gold_2025_05=CARD, notes="nothing,here\n")
    store = new_store(spark, tmp_path)

    def run(checkpoint, files=2):
        stream = ingest.read_statement_stream(spark, str(folder), files)
        ingest.statement_stream(stream, store, str(tmp_path / checkpoint), rules(spark), AS_OF).awaitTermination()

    run("ck")  # two batches; the golden test has the same rows from the batch run
    assert set(added(store)) == ADDED and len(added(store)) == len(ADDED)
    assert store.read("cash", jobs.CASH_STORAGE).count() == 1
    # A later file brings one new row, one row of before the watermark and one copy.
    later = "Posted,CHQ,NARRATION,OUT,IN,BAL\n02-05-2025,,too late,1.00,,\n10-06-2025,,STREAMBOX MONTHLY 7,64.00,,\n10-06-2025,,streambox  monthly 7,64.00,,\n"
    inbox(tmp_path, bank_north_main_2025_06=later)
    run("ck")
    after = added(store)
    assert [(a, c, d) for _, a, c, d in set(after) - ADDED] == [("-64.00", "Subscriptions", "")] and len(after) == len(ADDED) + 1
    assert [r.description for r in store.read("late", ingest.PARSED).collect()] == ["too late"]
    # The whole stream again from the start: everything is booked already.
    run("other", 10)
    assert added(store) == after


class Stopped(Exception):
    pass


@pytest.mark.parametrize("where", ["cc", "index"])
def test_booking_cut_short_is_finished(spark, tmp_path, monkeypatch, where):
    folder = inbox(tmp_path, bank_north_main_2025_05=BANK, cc_south_gold_2025_05=CARD)
    store = new_store(spark, tmp_path)
    Books(store).open()
    with monkeypatch.context() as m:
        append, put = LedgerStore.append_ledger, TableStore.put_partitions

        def broken_append(self, kind, df):
            if kind == "cc" and where == "cc":
                raise Stopped
            append(self, kind, df)

        def broken_put(self, name, *rest):
            put(self, name, *rest)
            if name == "index":
                raise Stopped

        m.setattr(LedgerStore, "append_ledger", broken_append)
        m.setattr(TableStore, "put_partitions", broken_put)
        with pytest.raises(Stopped):
            jobs.incremental_ingest(spark, store, str(folder), rules(spark), AS_OF)
    assert jobs.incremental_ingest(spark, store, str(folder), rules(spark), AS_OF).count() == 0
    assert set(added(store)) == ADDED and len(added(store)) == len(ADDED)
    assert same_index(Books(store).index, category_index.build_index(store.read_all(), "ledgers"))


def same_index(kept, built):
    votes = {tuple(r) for r in kept.votes().select("norm", "is_debit", "category", "votes", "first_seen").collect()}
    idf = {(r.token, r.df, round(r.idf, 12)) for r in kept.idf().collect()}
    return votes == {tuple(r) for r in built.votes.select("norm", "is_debit", "category", "votes", "first_seen").collect()} and idf == {
        (r.token, r.df, round(r.idf, 12)) for r in built.idf.collect()
    }


WORDS = "upi shop river stone cafe metro rent salary gold pay card 42".split()


def test_index_of_parts_equals_index_of_the_whole(spark, tmp_path):
    rng = random.Random(1)
    rows = [
        (
            f"2025-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", " ".join(rng.choices(WORDS, k=rng.randint(0, 5))), f"{rng.choice([-5, 5])}.00",
            rng.choice(["A", "B", "C", "Uncategorized", ""]), rng.choice(["bank-x", "cc-y"]),
        )
        for _ in range(120)
    ]
    cuts = sorted(rng.sample(range(len(rows)), 3))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    store = IndexStore(TableStore(spark, str(tmp_path / "s")), "index", "ledgers")
    store.rebuild(txns(spark, parts[0]), 0)
    for n, part in enumerate(parts[1:], 1):
        store.append(txns(spark, part), n)
        store.append(txns(spark, part), n)  # a repeated batch counts once
    whole = category_index.build_index(txns(spark, rows), "ledgers")
    assert same_index(store, whole)
    keys = category_index.query_keys(txns(spark, [(*r[:1], " ".join(rng.choices(WORDS, k=3)), *r[2:]) for r in rows[:40]]))

    def answers(index):
        exact = category_index.key_answers(keys, index).join(keys, ["norm", "is_debit"], "left_semi")
        return sorted((r.norm, r.is_debit, r.category, round(r.confidence, 9), r.found_by) for r in exact.collect())

    assert answers(store.load(keys)) == answers(whole)
    store.compact(force=True)
    assert len(store.generations()) == 1 and same_index(store, whole)
    assert not store.append(txns(spark, rows), len(parts) - 1)  # held by the compaction
    assert answers(store.load(keys)) == answers(whole)


def test_extracted_statements_follow_their_own_settings(spark, tmp_path):
    folder = tmp_path / "inbox"
    folder.mkdir()
    for name in ("bank-north-main-2025-05", "cc-south-gold-2025-05", "cc-south-gold-2025-06"):
        (folder / f"{name}.pdf").write_text("%PDF")
    ids = {n: f"file:{folder}/{n}.pdf" for n in ("bank-north-main-2025-05", "cc-south-gold-2025-05", "cc-south-gold-2025-06")}
    a, b, c = ids.values()
    rows = spark.createDataFrame(
        [
            (a, 1, 1, "05-05-2025", "STREAMBOX MONTHLY 8888", "64.00", ""),
            (a, 1, 2, "20-05-2025", "after the end", "7.00", ""),  # the printed period ends on the 10th
            (b, 1, 1, "12 May 25", "TUNEBOX PREMIUM 9921", "11.90", ""),
            (c, 1, 1, "12 Jun 25", "TUNEBOX PREMIUM 9922", "11.90", ""),
            (c, 1, 2, "13 Jun 25", "wrong amount", "119.00", ""),
            (c, 2, 1, "12 Jun 25", "TUNEBOX PREMIUM 9922", "11.90", ""),
        ],
        "statement_id string, attempt int, row_no long, date string, description string, debit string, credit string",
    )
    texts = spark.createDataFrame(
        [
            (a, "Period from 01 01-05-2025 until 10-05-2025\n05-05-2025 STREAMBOX MONTHLY 8888 64.00\n20-05-2025 after the end 7.00"),
            (b, "01/05/2025 - 31/05/2025\n12 May 25 TUNEBOX PREMIUM 9921 11.90"),
            (c, "01/06/2025 - 30/06/2025\n12 Jun 25 TUNEBOX PREMIUM 9922 11.90\n13 Jun 25 wrong amount 11.90"),
        ],
        "statement_id string, text string",
    )
    store = new_store(spark, tmp_path)
    given = jobs.Extracted(rows, texts)
    jobs.incremental_ingest(spark, store, str(folder), rules(spark), "2025-07-15", given)
    assert {r[0] for r in added(store)} == {"STREAMBOX MONTHLY 8888", "TUNEBOX PREMIUM 9921", "TUNEBOX PREMIUM 9922"}
    review = store.read("review", REVIEW).collect()
    assert [(r.description, r.reasons.split(":")[0]) for r in review] == [("after the end", "date_after_end")]
    done = {r.file_id: str(r.max_txn_date) for r in store.read("processed", jobs.PROCESSED).collect()}
    assert done == {b: "2025-05-12", c: "2025-06-12"}  # the flagged statement is read again next time
    jobs.incremental_ingest(spark, store, str(folder), rules(spark), "2025-07-15", given)
    assert len(added(store)) == 3 and store.read("review", REVIEW).count() == 1


def test_predicted_labels_enter_the_cache(spark, tmp_path):
    folder = inbox(tmp_path, bank_north_main_2025_05=BANK)
    store = new_store(spark, tmp_path)
    predicted = spark.createDataFrame(
        [("nameless vendor #", True, "Consulting"), ("ferry to the isle", True, "Dining")], "norm string, is_debit boolean, category string"
    )
    jobs.incremental_ingest(spark, store, str(folder), rules(spark), AS_OF, predictions=predicted)
    found = {r[0]: r[2:] for r in added(store)}
    assert found["nameless vendor 4042"] == ("Consulting", LOW_CONFIDENCE_REMARK) and found["ferry to the isle"][0] == "Travel"
    assert store.read("label-cache", LABEL_CACHE).count() == 2


def test_rewritten_ledgers_give_a_new_index(spark, tmp_path):
    store = new_store(spark, tmp_path)
    Books(store).open()
    store.overwrite_ledger("bank", txns(spark, [("2025-04-01", "STREAMBOX MONTHLY 1", "-64.00", "Other", "bank-north-main")]))
    books = Books(store).open()
    assert same_index(books.index, category_index.build_index(store.read_all(), "ledgers"))
    assert {(r.account, str(r.latest)) for r in books.watermark().collect()} == {("bank-north-main", "2025-04-01"), ("cc-south-gold", "2025-04-10")}


def test_backup_and_restore(spark, tmp_path):
    store = new_store(spark, tmp_path)
    assert jobs.backup_job(store) == 6
    store.truncate_ledger("bank")
    assert store.read_all().count() == 1
    assert jobs.restore_job(store) == {"bank": 5, "cc": 1}
    assert {r.description for r in store.read_all().collect()} == {r[1] for r in BEFORE}


def files_of(store, name):
    import glob

    return {f: open(f, "rb").read() for f in glob.glob(f"{store.location(name)}/**/*.parquet", recursive=True)}


def test_recategorise_rewrites_the_months_it_touches(spark, tmp_path):
    store = new_store(spark, tmp_path)
    rows = txns(spark, [("2025-06-01", "river cafe", "-3.00", "", "bank-north-main"), ("2025-06-02", "old shop", "-4.00", "Shop", "bank-north-main")])
    store.append_ledger("bank", rows)
    jobs.backup_job(store)
    before = {n: files_of(store, n) for n in ("ledger-bank", "ledger-cc")}
    written = jobs.recategorize_job(store, [{"category": "Food", "description": ["cafe"]}])
    assert written == {"bank": 2, "cc": 0}
    after = {n: files_of(store, n) for n in before}
    assert after["ledger-cc"] == before["ledger-cc"]
    kept = [f for f in before["ledger-bank"] if "month=2025-04" in f]
    assert kept and all(after["ledger-bank"].get(f) == before["ledger-bank"][f] for f in kept)
    assert {(r.description, r.category) for r in store.read_ledger("bank", ["2025-06"]).collect()} == {("river cafe", "Food"), ("old shop", "Shop")}
    assert same_index(Books(store).open().index, category_index.build_index(store.read_all(), "ledgers"))
    assert jobs.recategorize_job(store, MATCHERS) == {}


def test_append_overwrite_verify_truncate(spark, tmp_path):
    store = new_store(spark, tmp_path)
    assert store.overwrite_ledger("bank", txns(spark, [])) == 0 and store.read_ledger("bank").count() == 5  # empty input is a no-op
    assert store.overwrite_ledger("bank", txns(spark, BEFORE[:2])) == 2 and store.read_ledger("bank").count() == 2
    store.append_ledger("bank", txns(spark, BEFORE[2:3]))
    assert store.read_all().count() == 4
    with pytest.raises(VerificationFailed):
        store.verify(store.location("ledger-bank"), 4)
    header = spark.createDataFrame([("Date", "x"), ("2025-01-01", "y"), (" ", None)], "Date string, Description string")
    verify_rows(header, 1)
    with pytest.raises(VerificationFailed):
        verify_rows(header, 2)
    store.truncate_ledger("bank", first_row=False)
    assert store.read_ledger("bank").count() == 3
    store.truncate_ledger("bank")
    assert store.read_ledger("bank").count() == 0 and store.read_ledger("bank").columns == TXN.fieldNames()
