"""Steps that large tables go through: what they carry, and the same results."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from ledgerloom.checks.views import Inputs
from ledgerloom.functions.dates import parse_timestamp
from ledgerloom.operators import validate
from ledgerloom.sources.ledger import ledger_from_storage

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def test_a_date_is_read_once_whatever_its_reasons(spark):
    rows = spark.createDataFrame(
        [("05/01/2024", "paid 05/01/2024"), ("soon", "paid"), ("2024-01-09", "paid 2024-01-09"), ("2024-01-03", "x")], "date string, norm_text string"
    ).withColumn("date_formats", F.array(F.lit("dd/MM/yyyy"))).withColumn("last_date", F.lit("2024-01-08").cast("timestamp_ntz"))
    found = rows.select("date", F.array_join(F.array_compact(validate.date_reasons()), "; ").alias("r"))
    once = plan(rows.select(parse_timestamp("date", F.array_union("date_formats", F.array(F.lit(validate.ISO_PATTERN))))))
    assert plan(found).count("gettimestamp") <= once.count("gettimestamp")
    assert {r.date: r.r for r in found.collect()} == {
        "05/01/2024": "", "soon": "date_unparseable:'soon'", "2024-01-09": "date_after_end:2024-01-09>2024-01-08", "2024-01-03": "date_not_in_source:'2024-01-03'",
    }


def test_patterns_that_cannot_fit_change_no_date(spark):
    forms = ["dd/MM/yyyy", "yyyy-M-d", "[dd/]MM/yyyy", "yyyyMMdd", "d MMM yy", "d.M.yyyy", None]
    cells = ["05/01/2024", "2024-1-5", "20240105", "5 Jan 24", "5.1.2024", "someday", "", None]
    rows = spark.createDataFrame([(c, [f]) for c in cells for f in forms], "c string, f array<string>")
    both = rows.select("c", "f", parse_timestamp("c", F.col("f"), infer=False).alias("ours"), F.try_to_timestamp("c", F.get("f", F.lit(0))).cast("timestamp_ntz").alias("plain"))
    assert all(r.ours == r.plain for r in both.collect())


def test_only_asked_runs_are_proved(spark):
    asked = spark.createDataFrame([(1, "20.50"), (1, "20.50"), (1, "7"), (2, "8"), (3, "1"), (None, "1")], "statement_id int, run string")
    texts = spark.createDataFrame([(1, "fee 20.50 and 1,999 on 2024-01-05"), (1, "7 again 7 and 20.50"), (2, "80 18"), (3, None)], "statement_id int, text string")
    assert sorted(map(tuple, validate.proved_runs(asked, texts).collect())) == [(1, "20.50"), (1, "7")]


def test_best_attempt_meets_its_rows_once(spark):
    rows = [("s", 1, ["x"], 1), ("s", 1, [], 2), ("s", 2, ["y"], 3), ("s", 2, [], 4), ("s", 3, ["x"], 5), ("s", 3, ["x"], 6), ("t", 1, ["x"], 7), ("t", 2, [], 8), (None, 1, [], 9)]
    best = validate.best_attempt(spark.createDataFrame(rows, "statement_id string, attempt int, reasons array<string>, n int"))
    assert sorted(r.n for r in best.collect()) == [1, 2, 8]
    assert "Join" not in plan(best) and best.columns == ["statement_id", "attempt", "reasons", "n"]


def test_orders_are_summed_before_the_payroll_labels(spark):
    text = plan(Inputs(spark, SF).payroll_grid)
    assert "Join" not in text and "Cartesian" not in text
    lines = [i for i, x in enumerate(text.splitlines()) if "Generate" in x or "HashAggregate" in x]
    assert "Generate" in text.splitlines()[lines[0]]


def test_a_stored_amount_is_read_once(spark):
    stored = spark.createDataFrame([("2024-01-01", "a", "", "₹1,000.50 Dr"), ("2024-01-02", "b", "20", None), ("2024-01-03", "c", "oops", "1"), ("2024-01-04", "d", None, " ")], "Date string, Description string, Debit string, Credit string")
    read = ledger_from_storage(stored, strict=False)
    assert {r.description: str(r.amount) for r in read.collect()} == {"a": "-1000.50", "b": "-20.00", "d": "0.00"}
    # Twice for each side: once in the row and once in the filter.
    assert plan(read).count("[,₹$]") <= 4
