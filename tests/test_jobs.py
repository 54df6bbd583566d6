"""Composite jobs end to end: incremental ingest, backup, recategorise, summary feed."""

import json

import pytest

from ledgerloom.plans import jobs
from ledgerloom.sources.ledger import LedgerStore
from ledgerloom.sources.rules import RuleError, load_matchers, parsing_configs

CONFIG = {
    "bank-a": {
        "header_patterns": [["Tran Date", "PARTICULARS", "DR", "CR"]],
        "column_map": {"Tran Date": "date", "PARTICULARS": "description", "DR": "debit", "CR": "credit"},
        "date_formats": ["%d-%m-%Y"],
    }
}


def _rules(spark):
    accounts = spark.createDataFrame([("bank", "bank-a-main", 0)], "kind string, account string, idx int")
    matchers = [{"category": "Food", "description": ["cafe"]}, {"category": "Cash", "description": ["atm"]}]
    return jobs.Rules(accounts, parsing_configs(spark, CONFIG), matchers, mirror={"Cash": "in"})


def test_ingest_twice_then_backup_and_recategorise(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "bank-a-main-2024-01.csv").write_text(
        "Statement\n\nTran Date,PARTICULARS,DR,CR\n05-01-2024,CAFE ROMA,120.50,\n06-01-2024,ATM 12,500,\n07-01-2024,Unknown Co,,900\n"
    )
    store = LedgerStore(spark, str(tmp_path / "store"))
    first = jobs.incremental_ingest(spark, store, str(inbox), _rules(spark), "2024-02-15").collect()
    assert sum(r.rows for r in first) == 3
    rows = {r.description: (str(r.amount), r.category) for r in store.read_all().collect()}
    assert rows == {"CAFE ROMA": ("-120.50", "Food"), "ATM 12": ("-500.00", "Cash"), "Unknown Co": ("900.00", "Uncategorized")}
    assert store.read("cash", jobs.CASH_STORAGE).count() == 1
    second = jobs.incremental_ingest(spark, store, str(inbox), _rules(spark), "2024-02-15").collect()
    assert sum(r.rows for r in second) == 0 and store.read_all().count() == 3
    assert jobs.backup_job(store) == 3
    jobs.recategorize_job(store, [{"category": "Income", "description": ["unknown co"]}])
    after = {r.description: r.category for r in store.read_all().collect()}
    assert after == {"CAFE ROMA": "Food", "ATM 12": "Cash", "Unknown Co": "Income"}


def test_summary_feed_is_replaced_whole(spark, tmp_path):
    grid = spark.createDataFrame([("t", "Income", "₹1,000", 1), ("t", "Income", "₹900", 2)], "tenant_id string, label string, `2024` string, row_no int")
    held = spark.createDataFrame([("t", "₹100", "₹150", "5%", "50%")], "tenant_id string, invested string, value string, xirr string, profit_pct string")
    for updated in ("one", "two"):
        where = jobs.summary_feed(grid, held, "2024-05-01", updated, str(tmp_path / "feed"))
        assert where == jobs.current_feed(spark, str(tmp_path / "feed"))
    lines = [json.loads(x) for f in (tmp_path / "feed").glob("*/part-*") for x in f.read_text().splitlines()]
    assert [(x["updated"], x["income_raw"]) for x in lines] == [("two", 900.0)]


def test_pattern_the_jvm_refuses(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps([{"category": "A", "use_regex": True, "description": ["(?P<x>a)(?P=x)"]}]))
    with pytest.raises(RuleError, match="for Spark"):
        load_matchers(spark, str(tmp_path / "rules.json"))
