"""Parsing and standardising."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.checks.fragments import SPLIT, with_views
from ledgerloom.checks.registry import query
from ledgerloom.checks.views import Inputs
from ledgerloom.functions.amounts import parse_amount
from ledgerloom.functions.dates import datetime_pattern
from ledgerloom.operators import guard, standardize
from ledgerloom.sources.rules import parsing_configs

CONFIGS = {
    "bank-plain": {
        "header_patterns": [["Tran Date", "Particulars", "Amount (INR)", "Debit/Credit"]],
        "column_map": {"Tran Date": "date", "particulars": "description", "Amount (INR)": "amount", "Debit/Credit": "type"},
        "date_formats": ["%d/%m/%Y"],
        "amount_sign_col": "type",
        "debit_value": "Debit",
    },
    "bank-packed": {
        "header_patterns": [["Nothing", "Here"], ["Tran Date", "Particulars", "Amount (INR)", "Debit/Credit"]],
        "column_map": {"Tran Date": "date", "particulars": "description", "Amount (INR)": "amount", "Debit/Credit": "type"},
        "date_formats": ["%d/%m/%Y"],
        "amount_sign_col": "type",
        "debit_value": "Debit",
        "special_handling": standardize.TILDE_PACKED,
    },
}
FUTURE = "1999-06-30"


def _detected(t: Inputs):
    return standardize.detect_header(t.grid, t.grid_files, parsing_configs(t.spark, CONFIGS))


def _headers(t: Inputs):
    return standardize.with_configs(_detected(t).join(t.grid_files, "file_id"), parsing_configs(t.spark, CONFIGS))


# In the oracle the header row is where the views put it, or row 0 when unknown. Each step is
# materialised, and its row test is on one table, so the joins are plain equalities.
_GRID = """cells AS MATERIALIZED (
  SELECT *, CASE WHEN file_id % 5 = 0 THEN string_split(c0, '~') ELSE [c0, c1, c2, c3] END AS cells,
         CASE WHEN file_id % 10 = 9 THEN 0 ELSE file_id % 3 END AS header_row FROM stmt_grid),
headed AS MATERIALIZED (SELECT file_id, header_row, cells AS header, c0, c1, c2, c3 FROM cells WHERE row_no = header_row),
after_header AS MATERIALIZED (SELECT * FROM cells WHERE row_no > header_row),
body AS MATERIALIZED (SELECT c.*, h.header FROM after_header c JOIN headed h USING (file_id))"""
_SQL = with_views("stmt_grid", "grid_files", extra=(_GRID,))


@query(
    "a1_detect_header",
    _SQL + "SELECT file_id, CAST(header_row AS BIGINT) AS header_row, c0 || '|' || c1 || '|' || c2 || '|' || c3 AS header FROM headed",
)
def _(t: Inputs):
    return _detected(t).select("file_id", "header_row", F.array_join("header", "|").alias("header"))


@query(
    "a2_rows_to_records",
    with_views("stmt_grid", extra=(_GRID,))
    + "SELECT file_id, row_no, c0 || '|' || c1 || '|' || c2 || '|' || c3 AS cells FROM body",
)
def _(t: Inputs):
    return standardize.rows_to_records(t.grid, _detected(t)).select(
        "file_id", "row_no", F.array_join("cells", "|").alias("cells")
    )


@query(
    "a3_unpack_tilde",
    _SQL + "SELECT file_id, row_no, array_to_string(cells, '|') AS cells FROM body WHERE file_id % 5 <> 0 OR len(cells) = len(header)",
)
def _(t: Inputs):
    headers = standardize.unpack_tilde_header(_headers(t)).select("file_id", "header_row", "header", "special_handling")
    return standardize.unpack_tilde(standardize.rows_to_records(t.grid, headers)).select(
        "file_id", "row_no", F.array_join("cells", "|").alias("cells")
    )


@query(
    "a4_clean_cells",
    with_views("stmt_grid")
    + "SELECT file_id, row_no, nullif(trim(c0), '') AS c0, nullif(trim(c1), '') AS c1 FROM stmt_grid "
    "WHERE trim(c0) <> '' OR trim(c1) <> '' OR trim(c2) <> '' OR trim(c3) <> ''",
)
def _(t: Inputs):
    return standardize.clean_cells(t.grid).select(
        "file_id", "row_no", F.get("cells", F.lit(0)).alias("c0"), F.get("cells", F.lit(1)).alias("c1")
    )


@query(
    "a5_map_columns",
    _SQL
    + """SELECT file_id,
  CAST(nullif(list_position(list_transform(header, lambda h: lower(trim(h))), 'tran date'), 0) AS INTEGER) AS date_at,
  CAST(nullif(list_position(list_transform(header, lambda h: lower(trim(h))), 'particulars'), 0) AS INTEGER) AS description_at,
  CAST(nullif(list_position(list_transform(header, lambda h: lower(trim(h))), 'amount (inr)'), 0) AS INTEGER) AS amount_at,
  CAST(nullif(list_position(list_transform(header, lambda h: lower(trim(h))), 'debit/credit'), 0) AS INTEGER) AS sign_at
FROM headed""",
)
def _(t: Inputs):
    return standardize.map_columns(standardize.unpack_tilde_header(_headers(t))).select(
        "file_id", F.col("at.date").alias("date_at"), F.col("at.description").alias("description_at"),
        F.col("at.amount").alias("amount_at"), "sign_at",
    )


@query(
    "a6_parse_dates",
    with_views("stmt_cells") + "SELECT statement_id, row_no, date_text, true_date AS txn_date FROM stmt_cells",
)
def _(t: Inputs):
    formats = [datetime_pattern(f) for f in ("%d-%m-%Y", "%d/%m/%Y")]
    return standardize.parse_dates(t.stmt_cells, "date_text", formats).select(
        "statement_id", "row_no", "date_text", "txn_date"
    )


@query(
    "a7_parse_amount",
    with_views("stmt_cells")
    + "SELECT statement_id, row_no, amount_text, CASE WHEN amount_text LIKE '(%' OR amount_text LIKE '% Dr' THEN -price ELSE price END AS amount FROM stmt_cells",
)
def _(t: Inputs):
    return t.stmt_cells.select("statement_id", "row_no", "amount_text", parse_amount("amount_text").alias("amount"))


@query(
    "a8_signed_amount_pair",
    with_views("extracted")
    + "SELECT statement_id, l_partkey, l_suppkey, CAST(coalesce(TRY_CAST(credit AS DECIMAL(18,2)), 0) - coalesce(TRY_CAST(debit AS DECIMAL(18,2)), 0) AS DECIMAL(18,2)) AS amount FROM extracted",
)
def _(t: Inputs):
    return t.extracted.select(
        "statement_id", "l_partkey", "l_suppkey", standardize.signed_amount(F.col("debit"), F.col("credit")).alias("amount")
    )


@query(
    "a9_signed_amount_indicator",
    with_views("stmt_cells")
    + """SELECT statement_id, row_no, indicator, debit_value, CAST(CASE WHEN (debit_value = '' AND indicator = '')
       OR (indicator <> '' AND lower(trim(indicator)) = lower(debit_value)) THEN -price ELSE price END AS DECIMAL(18,2)) AS amount FROM stmt_cells""",
)
def _(t: Inputs):
    indicator = F.nullif(F.col("indicator"), F.lit(""))
    return t.stmt_cells.select(
        "statement_id", "row_no", "indicator", "debit_value",
        standardize.indicator_amount(F.col("price"), indicator, F.col("debit_value")).cast("decimal(18,2)").alias("amount"),
    )


_STD = """std AS (
  SELECT b.file_id, b.row_no, g.account, b.header_row,
         list_position(list_transform(b.header, lambda h: lower(trim(h))), 'debit/credit') > 0 AS has_sign,
         b.file_id % 10 = 9 AS no_date,
         nullif(trim(b.cells[1]), '') AS d, nullif(trim(b.cells[2]), '') AS descr, nullif(trim(b.cells[3]), '') AS a, nullif(trim(b.cells[4]), '') AS s
  FROM body b JOIN grid_files g USING (file_id)
  WHERE (b.file_id % 5 <> 0 OR len(b.cells) = len(b.header)) AND list_bool_or(list_transform(b.cells, lambda c: trim(c) <> ''))),
typed AS (
  SELECT *, TRY_CAST(TRY_STRPTIME(d, '%d/%m/%Y') AS DATE) AS txn_date,
         CASE WHEN a IS NULL THEN CAST(0 AS DECIMAL(18,2)) ELSE TRY_CAST(a AS DECIMAL(18,2)) END AS size FROM std),
out_rows AS (
  SELECT file_id, row_no, CASE WHEN no_date THEN NULL ELSE txn_date END AS txn_date,
         CASE WHEN no_date THEN '' ELSE coalesce(descr, '') END AS description,
         CAST(CASE WHEN no_date THEN NULL WHEN has_sign AND lower(s) = 'debit' THEN -size ELSE size END AS DECIMAL(18,2)) AS amount, account,
         CASE WHEN no_date THEN 'statement: no date column' WHEN txn_date IS NULL THEN 'row: unreadable date'
              WHEN size IS NULL THEN 'row: unreadable amount' WHEN txn_date > DATE '1999-06-30' THEN 'row: future date' END AS reject_reason
  FROM typed)"""
_STANDARD = with_views("stmt_grid", "grid_files", extra=(_GRID, _STD))


def _parsed(t: Inputs):
    return standardize.parse_statements(
        t.grid, t.grid_files, parsing_configs(t.spark, CONFIGS), FUTURE
    )


@query(
    "a10_signed_amount_plain",
    _STANDARD + "SELECT file_id, row_no, amount FROM out_rows WHERE reject_reason IS NULL",
)
def _(t: Inputs):
    good = standardize.accepted(_parsed(t))
    return good.select("file_id", "row_no", "amount")


@query(
    "a11_conform",
    with_views("incoming")
    + "SELECT txn_date, description, amount, 'Uncategorized' AS category, '' AS remarks, account FROM incoming",
)
def _(t: Inputs):
    return standardize.conform(t.incoming)


@query(
    "a12_drop_future",
    with_views("ledger") + f"SELECT * FROM ledger WHERE txn_date <= DATE '{FUTURE}'",
)
def _(t: Inputs):
    return standardize.drop_future(t.ledger, FUTURE)


@query(
    "a13_after_watermark",
    with_views("ledger", "incoming")
    + f"""SELECT i.txn_date, i.account, i.description, i.amount FROM incoming i
LEFT JOIN (SELECT account, max(txn_date) AS latest FROM ledger WHERE txn_date < {SPLIT} AND account LIKE '%brand1%' GROUP BY 1) w USING (account)
WHERE w.latest IS NULL OR i.txn_date > w.latest""",
)
def _(t: Inputs):
    wm = guard.latest_by_account(t.history.filter(F.col("account").contains("brand1")))
    return standardize.after_watermark(t.incoming, wm).select("txn_date", "account", "description", "amount")


@query(
    "a14_canonical_sort",
    with_views("ledger")
    + """SELECT *, row_number() OVER (ORDER BY txn_date, account, amount, description, category, remarks) - 1 AS position FROM ledger""",
)
def _(t: Inputs):
    # The position is where the row came out of the sorted partitions, not ranked anew.
    ordered = standardize.canonical_sort(t.ledger).withColumn("_part", F.spark_partition_id())
    at = ordered.withColumn("_row", F.monotonically_increasing_id()).withColumn("_first", F.col("_part").cast("long") * F.lit(1 << 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = at.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return at.join(F.broadcast(starts), "_part").select(*t.ledger.columns, (F.col("_row") - F.col("_first") + F.col("_base")).alias("position"))


@query(
    "a15_to_storage",
    with_views("ledger")
    + """SELECT CAST(txn_date AS STRING) AS "Date", description AS "Description", CASE WHEN amount < 0 THEN CAST(-amount AS STRING) ELSE '' END AS "Debit",
  CASE WHEN amount >= 0 THEN CAST(amount AS STRING) ELSE '' END AS "Credit", category AS "Category", remarks AS "Remarks", account AS "Account" FROM ledger""",
)
def _(t: Inputs):
    return standardize.to_storage(t.ledger)


@query("a16_parse_statements", _STANDARD + "SELECT * FROM out_rows")
def _(t: Inputs):
    return _parsed(t).select("file_id", "row_no", "txn_date", "description", "amount", "account", "reject_reason")


@query(
    "a16_reject_summary",
    _STANDARD + "SELECT file_id, reject_reason, count(*) AS rows, max(txn_date) AS latest FROM out_rows WHERE reject_reason IS NOT NULL GROUP BY 1, 2",
)
def _(t: Inputs):
    return standardize.reject_summary(_parsed(t))
