"""What a large table pays per row: each text and cell is read once, with the same results."""

import io
import random
import re
from contextlib import redirect_stdout
from datetime import date
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.checks import all_queries
from ledgerloom.checks.fragments import RULES
from ledgerloom.checks.statement_queries import CONFIGS, FUTURE
from ledgerloom.checks.views import Inputs
from ledgerloom.functions.amounts import parse_amount
from ledgerloom.functions.text import norm
from ledgerloom.operators import catalog, categorize, guard, standardize
from ledgerloom.schema import CANONICAL_ORDER
from ledgerloom.sources.rules import parsing_configs
from tests.test_growth import SF, plan

QUERIES = all_queries()


def _parsed(spark):
    t = Inputs(spark, SF)
    return standardize.parse_statements(t.grid, t.grid_files, parsing_configs(spark, CONFIGS), FUTURE)


def test_a_reject_summary_parses_each_row_once(spark):
    parsed = _parsed(spark)
    summary = standardize.reject_summary(parsed)
    # Each plan lists a projection once; a pushed filter would hold the same attempt again.
    assert plan(summary).count("gettimestamp") <= plan(parsed).count("gettimestamp")
    assert "HashAggregate(keys=[file_id" in plan(summary).split("Join")[0]
    assert summary.columns == ["file_id", "reject_reason", "rows", "latest"]
    plain = standardize.rejected(parsed).groupBy("file_id", "reject_reason").agg(F.count("*").alias("rows"), F.max("txn_date").alias("latest"))
    assert sorted(map(repr, summary.collect())) == sorted(map(repr, plain.collect()))


def test_header_positions_and_cells_are_cleaned_once(spark):
    headers = spark.createDataFrame(
        [([" Date ", "AMOUNT", "date", None], {"DATE": "date", "Amount": "amount", "Sign": "sign", "x": "amount"}, "sign")],
        "header array<string>, column_map map<string,string>, amount_sign_col string",
    )
    mapped = standardize.map_columns(headers)
    row = mapped.first()
    assert (row["at"]["date"], row["at"]["amount"], row["sign_at"], row["at"]["debit"]) == (3, 2, None, None)
    assert plan(mapped).count("array_position") == 1
    grid = spark.createDataFrame([(["", " ", None],), ([" a", "", "b "],), ([],), (None,)], "cells array<string>")
    cleaned = standardize.clean_cells(grid)
    assert [r["cells"] for r in cleaned.collect()] == [[" a", None, "b "]]
    assert plan(cleaned).count("transform(") == 1


def test_marks_are_looked_for_only_where_a_number_is_not_bare(spark):
    texts = ["12", "+1.50", "-.5", "1e3", "12 Cr", "12 Dr", "(7)", "(7) Dr", "5%", "₹1,000 Cr", "Cr", "1 2", "", " 3 ", "--4"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {r.t: r.a if r.a is None else str(r.a) for r in rows.select("t", parse_amount("t").alias("a")).collect()}
    assert found == {
        "12": "12.00", "+1.50": "1.50", "-.5": "-0.50", "1e3": "1000.00", "12 Cr": "12.00", "12 Dr": "-12.00", "(7)": "-7.00", "(7) Dr": None,
        "5%": "5.00", "₹1,000 Cr": "1000.00", "Cr": None, "1 2": None, "": "0.00", " 3 ": "3.00", "--4": None,
    }


def test_rules_read_a_row_once(spark):
    rows = spark.createDataFrame([("UPI-Red bolt", -1.0, "BANK-a"), (None, None, None)], "description string, amount double, account string")
    ruled = categorize.match_rules(rows, RULES)
    assert plan(ruled).count("lower(") <= 2
    assert [r.rule_category for r in ruled.collect()] == ["Expense:Hardware", None]


def test_norm_in_two_passes(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("aZ é/#-\t\n 09١😀İ", k=rng.randint(0, 12))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.lower("t").alias("low"), norm("t").alias("n"))
    for low, n in rows.collect():
        kept = re.sub(r"[^a-z#/ ]", " ", re.sub(r"[0-9]+", "#", low))
        assert n == re.sub(r"\s+", " ", kept).strip(" ")
    assert plan(rows.select("n")).count("regexp_replace") == 2


def test_accounts_are_looked_for_once_a_name(spark):
    names = ["BANK-a1-2024.csv", "bank-a12-2024.csv", "bank-b-cc-x.csv", "cc-x-2024-01.csv", "bank-none.csv"]
    files = spark.createDataFrame([(i, n) for i, n in enumerate(names * 3)], "file_id long, file_name string")
    accounts = spark.createDataFrame([("bank", "bank-a1", 0), ("bank", "Bank-a12", 0), ("cc", "cc-x", 0), ("bank", "bank-b", 1)], "kind string, account string, idx int")
    found = catalog.resolve_account(catalog.files_of_type(files), accounts)
    assert found.columns == ["file_id", "kind", "file_name", "account"]
    want = {"BANK-a1-2024.csv": ["bank-a1"], "bank-a12-2024.csv": ["Bank-a12"], "bank-b-cc-x.csv": ["bank-b", "cc-x"], "cc-x-2024-01.csv": ["cc-x"], "bank-none.csv": []}
    assert sorted((r.file_id, r.account) for r in found.collect()) == sorted((i, a) for i, n in enumerate(names * 3) for a in want[n])
    assert "HashAggregate(keys=[_name" in plan(found)


def test_category_examples_meet_by_their_first_rows(spark):
    t = Inputs(spark, SF)
    found = plan(categorize.category_examples(t.history, categorize.vocabulary(t.history, [])))
    assert found.count("row_number()") <= 3 and "partial_min(seen" in found


def test_files_are_not_dealt_by_their_few_settings(spark):
    schema = "file_id long, row_no long, cells array<string>"
    rows = [
        (1, 0, ["Statement", None]), (1, 2, ["DAY", "What"]), (1, 3, ["Day", "what"]), (2, 4, ["no", "header"]), (2, 5, ["neither"]),
        (3, 29, ["day", "what"]), (4, 30, ["day", "what"]), (5, 0, ["When"]), (6, 0, ["day", "what"]),
    ]
    files = spark.createDataFrame([(n, "b" if n == 5 else "none" if n == 6 else "a") for n in range(1, 8)], "file_id long, config_key string")
    configs = parsing_configs(spark, {"a": {"header_patterns": [["x"], ["Day", "What"]], "column_map": {}}, "b": {"header_patterns": [["when"]], "column_map": {}}})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = Inputs(spark, SF)
        found = standardize.detect_header(spark.createDataFrame(rows, schema), files, configs)
        for df in (found, QUERIES["a1_detect_header"](spark, SF), standardize.parse_statements(t.grid, t.grid_files, parsing_configs(spark, CONFIGS))):
            assert "hashpartitioning(config_key" not in plan(df)
        got = {r.file_id: (r.header_row, r.header) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {1: (2, ["DAY", "What"]), 2: (0, ["no", "header"]), 3: (29, ["day", "what"]), 5: (0, ["When"])}


def test_an_upsert_deals_no_ids(spark, monkeypatch):
    schema = "txn_date date, description string, amount decimal(18,2), category string, remarks string, account string"
    day, late = date(2001, 2, 3), date(9999, 12, 31)
    fresh = spark.createDataFrame(
        [
            (day, "x", Decimal("1.50"), "A", "", "a"), (day, "x", Decimal("1.50"), "B", None, "a"), (None, None, None, None, None, None),
            (day, "1-x", Decimal("2.00"), "C", "", "a"), (day, "x", Decimal("1.00"), "C", "", "a-2.00"), (late, "y", Decimal("-0.10"), "D", "", ""),
            (day, "x", Decimal("-5.00"), "E", "", "a"), (day, "-5.00-x", None, "F", "", "a"), (date(1, 1, 1), "old", Decimal("7.00"), "G", "", "a"),
        ],
        schema,
    )
    own = guard.backup_id(fresh)
    assert [r.d for r in guard.backup_id(fresh).filter("description = 'old'").select(F.date_format("txn_date", "yyyy-MM-dd").alias("d")).collect()] == ["0001-01-01"]
    formatted = F.sha2(F.concat_ws("-", F.date_format("txn_date", "yyyy-MM-dd"), F.coalesce("account", F.lit("")), F.coalesce(F.col("amount").cast("string"), F.lit("0.00")), F.coalesce("description", F.lit(""))), 256)
    assert own.filter(~F.col("id").eqNullSafe(formatted)).count() == 0
    taken = own.filter("category = 'D'").first().id
    old = own.withColumn("category", F.lit("Old")).unionByName(
        spark.createDataFrame(
            [
                (day, "gone", Decimal("3.00"), "H", "", "a", "by-hand"), (day, "gone too", Decimal("4.00"), "I", "", "a", "by-hand"),
                (day, "null", Decimal("3.00"), "J", "", "a", None), (day, "null 2", Decimal("3.00"), "K", "", "a", None),
                (day, "other row", Decimal("9.00"), "L", "", "a", taken), (day, "kept", Decimal("9.00"), "M", "", "a", "f" * 64),
            ],
            schema + ", id string",
        )
    )

    def plain(df, backup):
        rows = guard.backup_id(df).withColumn("_gen", F.lit(1))
        if backup is not None:
            rows = backup.withColumn("_gen", F.lit(0)).unionByName(rows)
        last = Window.partitionBy("id").orderBy(F.desc("_gen"), *[F.desc(c) for c in CANONICAL_ORDER])
        return rows.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1").drop("_rank", "_gen")

    wide = old.withColumn("amount", F.col("amount").cast("decimal(20,4)") + F.when(F.col("description") == "x", F.lit("0.0001").cast("decimal(20,4)")).otherwise(0))
    for backup in (None, old, old.limit(0), wide):
        got, want = guard.backup_upsert(fresh, backup), plain(fresh, backup)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        monkeypatch.setattr(guard.F, "xxhash64", lambda *_: F.lit(7).cast("long"))  # all ids in one deal
        got = guard.backup_upsert(fresh, backup)
        monkeypatch.undo()
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    out = io.StringIO()
    with redirect_stdout(out):
        guard.backup_upsert(fresh, old).explain("formatted")
    sorts = re.findall(r"\(\d+\) Sort\nInput \[\d+\]: \[(.*?)\]\n", out.getvalue())
    assert len(sorts) == 1 and not re.search(r"\bid#", sorts[0])
    moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", out.getvalue())
    assert moved and not any(re.search(r"\bid#", columns) for columns in moved)
