"""No caps: wide statements, long rule lists, unreadable amounts, odd periods and ids."""

import datetime
import random
import re

import pytest

from ledgerloom.checks import catalog_queries
from ledgerloom.checks.views import Inputs
from ledgerloom.operators import catalog, categorize, dedup, payroll, validate
from ledgerloom.sources.ledger import ledger_from_storage, unreadable_amounts
from ledgerloom.sources.statements import read_statement_rows


def test_statement_of_forty_columns_and_blank_lines(spark, tmp_path):
    wide = ",".join(f"c{i}" for i in range(40))
    (tmp_path / "a.csv").write_text(f'Title\n\n{wide}\r\n"x, ""y""\nz",2\n')
    rows = {r.row_no: r.cells for r in read_statement_rows(spark, str(tmp_path)).collect()}
    assert rows[0] == ["Title"] and rows[1] == [] and len(rows[2]) == 40 and rows[2][39] == "c39"
    assert rows[3] == ['x, "y"\nz', "2"] and len(rows) == 4


def test_ignore_list_of_five_thousand_rules(spark):
    rows = spark.createDataFrame(
        [("Shop 4999 buy", "bank-a"), ("Shop 77 buy", "bank-b"), ("Other", None), (None, "bank-a")], "description string, account string"
    )
    rules = [{"description_contains": f"shop {i} b", "account": "bank-a" if i % 2 else None} for i in range(5000)]
    kept = {r.description for r in dedup.drop_ignored(rows, [*rules, {"description_contains": " "}]).collect()}
    assert kept == {"Shop 77 buy", "Other", None}


def test_rules_beyond_any_block(spark):
    rows = spark.createDataFrame([("pay 399 now", -1.0, "bank"), ("nothing", -1.0, "bank")], "description string, amount double, account string")
    rules = [{"category": f"C{i}", "description": [f"pay {i} "]} for i in range(400)]
    found = {r.description: r.rule_category for r in categorize.match_rules(rows, rules).collect()}
    assert found == {"pay 399 now": "C399", "nothing": None}


def test_unreadable_stored_amount_stops_the_read(spark):
    stored = spark.createDataFrame(
        [("2024-01-01", "a", "1.00", ""), ("2024-01-02", "b", "", "oops")], "Date string, Description string, Debit string, Credit string"
    )
    with pytest.raises(Exception, match="unreadable amount"):
        ledger_from_storage(stored).collect()
    assert ledger_from_storage(stored, strict=False).count() == 1
    assert [r.Description for r in unreadable_amounts(stored).collect()] == ["b"]


def test_odd_period_does_not_stop_the_others(spark):
    slips = spark.createDataFrame([("t", "2024-ab"), ("t", "2024-13"), ("t", "2024-02")], "tenant_id string, period string")
    none = spark.createDataFrame([], "tenant_id string, description string")
    assert [r.period for r in payroll.unsplit_periods(slips, none).collect()] == ["2024-02"]
    assert payroll.bad_periods(slips).count() == 2


def test_copy_names_with_text_ids_and_two_configurations(spark):
    day = datetime.date(2024, 1, 1)
    mails = spark.createDataFrame(
        [("18c3f0", 0, "a.pdf", day), ("18c3f0", 1, "a.pdf", day), ("x", 0, "a.pdf", day)],
        "mail_id string, config_idx int, base_name string, received_at date",
    )
    stored = spark.createDataFrame([("a.pdf",), ("a_copy2.pdf",)], "file_name string")
    names = sorted(r.file_name for r in catalog.assign_copy_names(mails, stored).collect())
    assert names == ["a_copy1.pdf", "a_copy3.pdf", "a_copy4.pdf"]


@pytest.mark.parametrize(
    "debit,text,ok",
    [("20", "fee 20.50", True), ("20", "fee 20.00", True), ("20.5", "fee 20.50", True), ("20", "fee 120", False), ("1234", "paid 1,234.00", True)],
)
def test_amount_on_digit_boundaries(spark, debit, text, ok):
    rows = spark.createDataFrame([("s", 1, "2024-01-05", "x", debit, "")], "statement_id string, attempt int, date string, description string, debit string, credit string")
    statements = spark.createDataFrame([("s", f"2024-01-05 x {text}", None)], "statement_id string, text string, period_end date")
    reasons = validate.validate_rows(rows, statements, "2024-02-01").first().reasons
    assert (not reasons) == ok, reasons


def test_five_thousand_rules_by_index_equal_the_case(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("shop", "cafe", "rail", "Ünï") for b in range(300)]
    rules = []
    for i in range(5000):
        r = {"category": f"C{i}", "description": [rng.choice([f"{rng.choice(words)} {rng.choice(words)}", rng.choice(words), "zz", "q"])]}
        if i % 3 == 0:
            r["debit"] = bool(i % 2)
        if i % 5 == 0:
            r["account"] = rng.choice(["BANK-a", "cc"])
        if i % 1000 == 7:
            r |= {"use_regex": True, "description": [rf"^{rng.choice(words)}\b.*{rng.choice(words)}$"]}
        if i % 7 == 0:
            del r["category"]
        rules.append(r)
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 4))).upper(), rng.choice([-1.0, 1.0, None]), rng.choice(["bank-a", "cc-b", None])) for _ in range(150)]
    df = spark.createDataFrame([*rows, (None, 1.0, "cc-b"), ("Q", 2.0, None)], "description string, amount double, account string")

    def plain(desc, amount, account):
        d, a = (desc or "").lower(), (account or "").lower()
        for r in rules:
            if isinstance(r.get("debit"), bool) and r["debit"] != (amount is not None and amount < 0):
                continue
            if r.get("account") and r["account"].lower() not in a:
                continue
            if any(p.lower() in d or (r.get("use_regex") and re.search(p, d, re.I)) for p in r["description"]):
                return r.get("category", "Uncategorized")
        return None

    found = categorize.match_rules(df, rules).collect()
    assert len(found) == df.count()
    assert all(r.rule_category == plain(r.description, r.amount, r.account) for r in found)
    assert sum(r.rule_category is not None for r in found) > 100
    short = categorize.match_rules(df, rules[:150]).collect()
    again = categorize.match_rules_indexed(df, rules[:150]).collect()
    assert sorted(map(repr, short)) == sorted(map(repr, again))


def test_written_statements_are_bounded_files(spark, monkeypatch):
    monkeypatch.setattr(catalog_queries, "FILE_ROWS", 100)
    inputs = Inputs(spark, "/root/testdata/sf0.001")
    rows = read_statement_rows(spark, catalog_queries._written_statements(inputs))
    per_file = [r["count"] for r in rows.groupBy("file_id").count().collect()]
    assert max(per_file) <= 100 and sum(per_file) == inputs.stmt_cells.count()
