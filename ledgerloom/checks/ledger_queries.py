"""L, M, V, F, H, P and T: ledgers, mirrors, validation, figures, health, payroll, messages."""

from pyspark.sql import functions as F

from ledgerloom.checks.fragments import DOCS, EXACT, HISTORY, IDF, MIRROR, RULES, VOTES, labelled, norm, queries_of, rule_case, with_views
from ledgerloom.checks.registry import query
from ledgerloom.checks.views import AS_OF, Inputs
from ledgerloom.functions import amounts, text
from ledgerloom.operators import cash, dedup, guard, health, messages, payroll, standardize, summary, validate

_LEDGER = with_views("ledger")
_KIND = "CASE WHEN account LIKE 'bank%' THEN 'bank' WHEN account LIKE 'cc%' THEN 'cc' ELSE 'unknown' END"


@query("l1_latest_by_account", _LEDGER + "SELECT account, max(txn_date) AS latest FROM ledger GROUP BY account")
def _(t: Inputs):
    return guard.latest_by_account(t.ledger)


@query("l2_latest_overall", _LEDGER + "SELECT max(txn_date) AS latest FROM ledger")
def _(t: Inputs):
    return guard.latest_overall(t.ledger)


@query("l3_backup_counts", _LEDGER + f"SELECT {_KIND} AS ledger, count(*) AS rows FROM ledger GROUP BY 1")
def _(t: Inputs):
    return guard.backup_counts(t.ledger)


@query(
    "l4_check_overwrite",
    with_views("ledger", extra=(HISTORY,))
    + f"""SELECT k.ledger, coalesce(h.n, 0) AS have, coalesce(b.n, 0) AS base,
  CASE WHEN k.ledger = 'unknown' AND coalesce(h.n, 0) > 0 THEN 'unknown accounts'
       WHEN coalesce(b.n, 0) > 0 AND coalesce(h.n, 0) < 0.9 * b.n THEN 'truncated read' END AS verdict
FROM (VALUES ('bank'), ('cc'), ('unknown')) k(ledger)
LEFT JOIN (SELECT {_KIND} AS ledger, count(*) AS n FROM history WHERE account NOT LIKE 'cc-brand1%' GROUP BY 1) h ON h.ledger = k.ledger
LEFT JOIN (SELECT {_KIND} AS ledger, count(*) AS n FROM ledger GROUP BY 1) b ON b.ledger = k.ledger""",
)
def _(t: Inputs):
    return guard.check_overwrite(t.history.filter("account NOT LIKE 'cc-brand1%'"), t.ledger)


_ID = "sha256(strftime(txn_date, '%Y-%m-%d') || '-' || account || '-' || CAST(amount AS STRING) || '-' || description)"


@query(
    "l9_backup_upsert",
    with_views("ledger", extra=(HISTORY,))
    + f"""SELECT txn_date, description, amount, category, remarks, account, {_ID} AS id FROM (
  SELECT *, row_number() OVER (PARTITION BY {_ID} ORDER BY gen DESC, txn_date DESC, account DESC, amount DESC, description DESC, category DESC, remarks DESC) AS rk
  FROM (SELECT txn_date, description, amount, 'Old' AS category, remarks, account, 0 AS gen FROM history
        UNION ALL SELECT txn_date, description, amount, category, remarks, account, 1 FROM ledger) g) r WHERE rk = 1""",
)
def _(t: Inputs):
    old = guard.backup_id(t.history.withColumn("category", F.lit("Old")))
    return guard.backup_upsert(t.ledger, old)


@query(
    "l10_restore",
    _LEDGER + f"SELECT txn_date, description, amount, category, remarks, account, {_KIND} AS ledger FROM ledger",
)
def _(t: Inputs):
    return guard.restore(t.ledger)


_TODO = f"""todo AS (
  SELECT *, {norm('description')} AS norm, amount < 0 AS is_debit, {rule_case()} AS by_rule FROM ledger WHERE NOT {labelled()})"""
_TODO_KEYS = "SELECT DISTINCT norm, is_debit FROM todo"


@query(
    "l11_recategorize",
    with_views("ledger", extra=("history AS (SELECT * FROM ledger)", VOTES, EXACT, IDF, DOCS, _TODO, queries_of(_TODO_KEYS)))
    + f"""SELECT txn_date, account, description, amount, category, remarks FROM ledger WHERE {labelled()}
UNION ALL
SELECT txn_date, account, description, amount, category, CASE WHEN low THEN 'REVIEW: low-confidence auto-category'
  WHEN category = 'Uncategorized' THEN 'REVIEW: auto-categorization uncertain' ELSE '' END AS remarks
FROM (SELECT t.*, coalesce(e.category, t.by_rule, f.category, 'Uncategorized') AS category,
        e.category IS NULL AND t.by_rule IS NULL AND f.category IS NOT NULL AS low
      FROM (SELECT txn_date, account, description, amount, norm, is_debit, by_rule FROM todo) t
      LEFT JOIN exact e ON e.norm = t.norm AND e.is_debit = t.is_debit LEFT JOIN fuzzy f ON f.norm = t.norm AND f.is_debit = t.is_debit) x""",
)
def _(t: Inputs):
    return guard.recategorize(t.ledger, RULES).select("txn_date", "account", "description", "amount", "category", "remarks")


_MARK = """'auto:' || account || ':' || strftime(txn_date, '%Y-%m-%d') || ':' || CAST(amount AS STRING) || ':' ||
  substr(sha1(regexp_replace(lower(description), '[^a-z0-9]', '', 'g')), 1, 8)"""


@query("m1_mirror_marker", _LEDGER + f"SELECT *, {_MARK} AS marker FROM ledger")
def _(t: Inputs):
    return cash.mirror_marker(t.ledger)


# Half of the mirrored rows are in the cash ledger already.
_CASH = f"cash AS (SELECT 'by hand ' || {_MARK} AS remarks FROM ledger WHERE day(txn_date) % 2 = 0)"


def _cash(t: Inputs):
    rows = cash.mirror_marker(t.ledger.filter(F.dayofmonth("txn_date") % 2 == 0))
    return rows.select(F.concat(F.lit("by hand "), "marker").alias("Remarks"))


@query(
    "m2_existing_markers",
    with_views("ledger", extra=(_CASH,)) + "SELECT DISTINCT regexp_extract(remarks, '(auto:[^\\s]+)', 1) AS marker FROM cash",
)
def _(t: Inputs):
    return cash.existing_markers(_cash(t))


_DIRECTION = "CASE category " + " ".join(f"WHEN '{c}' THEN '{d}'" for c, d in MIRROR.items()) + " END"


@query(
    "m3_mirror_cash",
    with_views("ledger", extra=(_CASH,))
    + f"""SELECT strftime(txn_date, '%Y-%m-%d') AS "Date", description AS "Description",
  CASE WHEN direction = 'in' THEN '' ELSE CAST(abs(amount) AS STRING) END AS "Debit",
  CASE WHEN direction = 'in' THEN CAST(abs(amount) AS STRING) ELSE '' END AS "Credit", category AS "Category", marker AS "Remarks"
FROM (SELECT *, row_number() OVER (PARTITION BY marker ORDER BY txn_date, account, amount, description, category, remarks) AS rk
      FROM (SELECT *, {_MARK} AS marker, {_DIRECTION} AS direction FROM ledger) m WHERE direction IS NOT NULL) r
WHERE rk = 1 AND marker NOT IN (SELECT regexp_extract(remarks, '(auto:[^\\s]+)', 1) FROM cash)""",
)
def _(t: Inputs):
    return cash.mirror_cash(t.ledger, MIRROR, _cash(t))


_NORM = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
_TEXTS = f"""stmt_text AS (SELECT statement_id, string_agg(line, chr(10) ORDER BY line) AS text FROM stmt_lines GROUP BY 1),
texts AS (SELECT statement_id, {_NORM} AS norm_text, replace({_NORM}, ',', '') AS plain FROM stmt_text)"""


@query("v1_norm_text", with_views("stmt_lines", extra=(_TEXTS,)) + "SELECT statement_id, norm_text FROM texts")
def _(t: Inputs):
    return t.stmt_text.select("statement_id", text.norm_text("text").alias("norm_text"))


_AMOUNT = "(regexp_matches(plain, '(^|[^0-9])' || replace({0}, '.', '\\.') || '($|[^0-9])') OR (position('.00' IN {0}) > 0 AND regexp_matches(plain, '(^|[^0-9])' || replace({0}, '.00', '') || '(\\.0+)?($|[^0-9])')))"
_CHECKED = f"""checked AS (
  SELECT e.*, x.norm_text, x.plain,
    CASE WHEN position(e.date IN x.norm_text) = 0 THEN 'date_not_in_source:''' || e.date || '''' END AS r1,
    CASE WHEN CAST(e.date AS DATE) > DATE '{AS_OF}' THEN 'date_after_end:' || e.date || '>{AS_OF}' END AS r2,
    CASE WHEN e.debit <> '' AND NOT {_AMOUNT.format('e.debit')} THEN 'debit_not_in_source:''' || e.debit || '''' END AS r3,
    CASE WHEN e.credit <> '' AND NOT {_AMOUNT.format('e.credit')} THEN 'credit_not_in_source:''' || e.credit || '''' END AS r4
  FROM extracted e JOIN texts x USING (statement_id))"""
_VALID = with_views("stmt_lines", "extracted", extra=(_TEXTS, _CHECKED))


def _validated(t: Inputs, rows=None):
    statements = t.stmt_text.withColumn("period_end", F.lit(None).cast("date"))
    return validate.validate_rows(t.extracted if rows is None else rows, statements, AS_OF)


@query(
    "v7_validate_rows",
    _VALID + "SELECT statement_id, l_partkey, l_suppkey, date, debit, credit, concat_ws('; ', r1, r2, r3, r4) AS reasons FROM checked",
)
def _(t: Inputs):
    return _validated(t).select(
        "statement_id", "l_partkey", "l_suppkey", "date", "debit", "credit", F.array_join("reasons", "; ").alias("reasons")
    )


@query(
    "v6_description_overlap",
    _VALID
    + """SELECT statement_id, l_partkey, l_suppkey, CASE WHEN len(w) = 0 THEN false
  ELSE len(list_filter(w, lambda x: contains(norm_text, x))) < 0.5 * len(w) END AS low_confidence
FROM (SELECT *, list_filter(regexp_extract_all(lower(description), '[a-z0-9]+'), lambda x: length(x) >= 4) AS w FROM checked) c""",
)
def _(t: Inputs):
    return _validated(t).select("statement_id", "l_partkey", "l_suppkey", "low_confidence")


@query(
    "v8_count_sanity",
    with_views("stmt_lines", "extracted", extra=(_TEXTS,))
    + """SELECT statement_id, rows, dates, rows >= 5 AND dates > 0 AND NOT (dates <= rows * 3 AND rows <= dates * 3) AS count_mismatch
FROM (SELECT statement_id, count(*) AS rows FROM extracted GROUP BY 1) c
JOIN (SELECT statement_id, CAST(len(regexp_extract_all(norm_text, '\\b[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\\b')) + len(regexp_extract_all(norm_text, '\\b[0-9]{1,2} [a-z]{3} [0-9]{2,4}\\b')) AS BIGINT) AS dates FROM texts) d USING (statement_id)""",
)
def _(t: Inputs):
    counts = t.extracted.groupBy("statement_id").agg(F.count("*").alias("rows"))
    return validate.count_sanity(counts, t.stmt_text)


_SAID = "'txns {0} ' || CAST(CAST({1} AS DECIMAL(28,2)) AS STRING) || ' vs {2} ' || CAST(CAST({3} AS DECIMAL(28,2)) AS STRING)"
_NEAR = "abs({0} - {1}) <= greatest(2.0, 0.0025 * abs({1}))"


@query(
    "v9_reconcile",
    with_views("extracted", "summaries")
    + f""", sums AS (
  SELECT statement_id, sum(CASE WHEN debit = '' THEN 0 ELSE CAST(debit AS DECIMAL(18,2)) END) AS sd,
         sum(CASE WHEN credit = '' THEN 0 ELSE CAST(credit AS DECIMAL(18,2)) END) AS sc FROM extracted GROUP BY 1),
j AS (
  SELECT s.statement_id, coalesce(sd, 0) AS sd, coalesce(sc, 0) AS sc, TRY_CAST(nullif(total_debit, '') AS DECIMAL(18,2)) AS td,
         TRY_CAST(nullif(total_credit, '') AS DECIMAL(18,2)) AS tc,
         abs(TRY_CAST(nullif(closing_balance, '') AS DECIMAL(18,2)) - TRY_CAST(replace(nullif(opening_balance, ''), ',', '') AS DECIMAL(18,2))) AS net
  FROM summaries s LEFT JOIN sums USING (statement_id)),
m AS (SELECT *, td IS NOT NULL AND tc IS NOT NULL AND (net IS NULL OR {_NEAR.format('abs(td - tc)', 'net')}) AS sides FROM j)
SELECT statement_id, 'debit' AS side, {_SAID.format('sum', 'sd', 'statement', 'td')} AS message FROM m WHERE (sides OR (net IS NULL AND td IS NOT NULL)) AND NOT ({_NEAR.format('sd', 'td')})
UNION ALL SELECT statement_id, 'credit', {_SAID.format('sum', 'sc', 'statement', 'tc')} FROM m WHERE (sides OR (net IS NULL AND tc IS NOT NULL)) AND NOT ({_NEAR.format('sc', 'tc')})
UNION ALL SELECT statement_id, 'net', {_SAID.format('net', 'abs(sd - sc)', 'balances', 'net')} FROM m WHERE NOT sides AND net IS NOT NULL AND NOT ({_NEAR.format('abs(sd - sc)', 'net')})""",
)
def _(t: Inputs):
    return validate.reconcile(t.extracted, t.summaries)


@query(
    "v10_best_attempt",
    _VALID
    + """, flags AS (
  SELECT statement_id, count(*) FILTER (WHERE coalesce(r1, r2, r3, r4) IS NOT NULL) AS b1 FROM checked GROUP BY 1)
SELECT statement_id, CAST(CASE WHEN b1 > 0 THEN 2 ELSE 1 END AS INTEGER) AS attempt, l_partkey, l_suppkey, date, debit, credit
FROM flags JOIN checked USING (statement_id)""",
)
def _(t: Inputs):
    # The second attempt carries no amounts or dates to doubt, so it flags nothing.
    first = _validated(t, t.extracted.withColumn("attempt", F.lit(1)))
    second = first.withColumn("attempt", F.lit(2)).withColumn("reasons", F.slice("reasons", 1, 0))
    return validate.best_attempt(first.unionByName(second)).select("statement_id", "attempt", "l_partkey", "l_suppkey", "date", "debit", "credit")


@query(
    "v11_review_rows",
    _VALID
    + """SELECT 'acc' AS account, date, description, debit, credit, concat_ws('; ', r1, r2, r3, r4) AS reasons, CAST(statement_id AS STRING) || '.pdf' AS file
FROM checked WHERE coalesce(r1, r2, r3, r4) IS NOT NULL
UNION ALL SELECT 'acc', '', 'STATEMENT', '', '', 'checked', CAST(statement_id AS STRING) || '.pdf' FROM stmt_text WHERE statement_id % 9 = 0""",
)
def _(t: Inputs):
    files = t.stmt_text.select("statement_id", F.lit("acc").alias("account"), F.concat(F.col("statement_id").cast("string"), F.lit(".pdf")).alias("file_name"))
    flags = t.stmt_text.filter("statement_id % 9 = 0").select("statement_id", F.lit("checked").alias("flag"))
    return validate.review_rows(_validated(t), flags, files)


@query(
    "f4_annual_figures",
    with_views("year_cells")
    + """, typed AS (SELECT tenant_id, TRY_CAST(header AS INTEGER) AS year, label, TRY_CAST(replace(cell, '₹', '') AS DECIMAL(28,2)) AS v FROM year_cells),
pick AS (SELECT tenant_id, coalesce(max(year) FILTER (WHERE year = 1997), max(year)) AS year FROM typed WHERE year IS NOT NULL GROUP BY 1)
SELECT tenant_id, year, max(v) FILTER (WHERE label = 'Income') AS income, max(v) FILTER (WHERE label = 'Regular Expenses') AS regular_expenses,
  max(v) FILTER (WHERE label = 'New Investments') AS new_investments
FROM typed JOIN pick USING (tenant_id, year) GROUP BY 1, 2""",
)
def _(t: Inputs):
    return summary.annual_figures_long(t.year_cells, "1997-06-30")


@query(
    "f5_holdings",
    with_views("holding_cells")
    + """SELECT tenant_id, v AS value, i AS invested, CAST(v - i AS DECIMAL(28,2)) AS profit FROM (
  SELECT tenant_id, TRY_CAST(replace(replace(value, '₹', ''), '−', '-') AS DECIMAL(28,2)) AS v, TRY_CAST(replace(invested, '₹', '') AS DECIMAL(28,2)) AS i FROM holding_cells) h""",
)
def _(t: Inputs):
    return summary.holdings(t.holding_cells).select("tenant_id", "value", "invested", "profit")


@query(
    "h1_fetch_status",
    with_views("fetch_log")
    + """SELECT tenant_id, max(attempt_date) AS last_attempt, max(attempt_date) FILTER (WHERE new_count > 0) AS last_new_date,
  coalesce((max(struct_pack(a := attempt_date, n := new_count)) FILTER (WHERE new_count > 0)).n, 0) AS last_new_count FROM fetch_log GROUP BY 1""",
)
def _(t: Inputs):
    return health.fetch_status(t.fetch_log).withColumn("last_new_count", F.coalesce("last_new_count", F.lit(0)))


@query(
    "h3_evaluate_health",
    with_views("fetch_log")
    + """, s AS (SELECT tenant_id, max(attempt_date) FILTER (WHERE new_count > 0) AS found, max(attempt_date) AS latest FROM fetch_log GROUP BY 1)
SELECT tenant_id, fetch_note IS NULL AND txn_note IS NULL AS is_up,
  CASE WHEN fetch_note IS NULL AND txn_note IS NULL THEN 'OK | +0 pdfs | latest txn ' || CAST(latest AS STRING) ELSE concat_ws('; ', fetch_note, txn_note) END AS message
FROM (SELECT *, CASE WHEN found IS NULL THEN 'no statement PDF ever fetched' WHEN DATE '1998-08-15' - found > 45
               THEN 'no new statement in ' || (DATE '1998-08-15' - found) || 'd' END AS fetch_note,
             CASE WHEN DATE '1998-08-15' - latest > 45 THEN 'latest txn ' || (DATE '1998-08-15' - latest) || 'd old' END AS txn_note FROM s) x""",
)
def _(t: Inputs):
    status = health.fetch_status(t.fetch_log)
    latest = t.fetch_log.groupBy("tenant_id").agg(F.max("attempt_date").alias("latest")).withColumn("pipeline_error", F.lit(""))
    verdicts = health.evaluate_health(latest.withColumn("new_count", F.lit(0).cast("long")), status, "1998-08-15")
    return verdicts.select("tenant_id", "is_up", "message")


_SPLITS = {
    "Total Salary": {"category": "Income:Salary", "sign": "credit"},
    "Total Tax": {"category": "Tax", "sign": "debit"},
    "Small Savings": {"category": "Savings", "sign": "debit"},
}


@query(
    "p3_payroll_block",
    with_views("payroll_grid")
    + "SELECT tenant_id, CAST(year AS STRING) || '-' || m AS period, label, CAST(value AS DECIMAL(28,2)) AS value FROM ("
    + " UNION ALL ".join(f"SELECT tenant_id, year, label, '{m:02d}' AS m, m{m:02d} AS value FROM payroll_grid" for m in range(1, 13))
    + ") g WHERE value IS NOT NULL",
)
def _(t: Inputs):
    return payroll.payroll_block(t.payroll_grid)


@query(
    "p4_split_payroll",
    with_views("payroll_grid")
    + "SELECT tenant_id, CAST(year AS STRING) || '-' || m AS period, label, CASE label WHEN 'Total Salary' THEN 'Income:Salary' WHEN 'Total Tax' THEN 'Tax' ELSE 'Savings' END AS category, "
    + "CAST(CASE WHEN label = 'Total Salary' THEN value ELSE -value END AS DECIMAL(18,2)) AS amount FROM ("
    + " UNION ALL ".join(f"SELECT tenant_id, year, label, '{m:02d}' AS m, m{m:02d} AS value FROM payroll_grid" for m in range(1, 13))
    + ") g WHERE abs(value) >= 0.5 AND label IN ('Total Salary', 'Total Tax', 'Small Savings')",
)
def _(t: Inputs):
    return payroll.split_payroll(payroll.payroll_block(t.payroll_grid), _SPLITS)


@query(
    "p7_unsplit_periods",
    with_views("payslips") + "SELECT tenant_id, period FROM payslips WHERE CAST(right(period, 2) AS INTEGER) % 2 = 1",
)
def _(t: Inputs):
    done = t.payslips.filter("CAST(right(period, 2) AS INT) % 2 = 0").select(
        "tenant_id", payroll.synthetic_description("period").alias("description")
    )
    return payroll.unsplit_periods(t.payslips, done)


@query(
    "p8_pay_date",
    with_views("payslips")
    + """SELECT tenant_id, period, coalesce(TRY_CAST(date_of_payment AS DATE), CAST(TRY_STRPTIME(date_of_payment, '%d/%m/%Y') AS DATE), last_day(CAST(period || '-01' AS DATE))) AS pay_date FROM payslips""",
)
def _(t: Inputs):
    return t.payslips.select("tenant_id", "period", payroll.pay_date("date_of_payment", "period").alias("pay_date"))


_USERS = {i: f"user-{i}" for i in range(1, 400)}


@query(
    "t2_authorised",
    with_views("cash_msgs") + "SELECT update_id, 'user-' || user_id AS label FROM cash_msgs WHERE user_id BETWEEN 1 AND 399",
)
def _(t: Inputs):
    return messages.authorised(t.cash_msgs, -100, _USERS).select("update_id", "label")


@query(
    "t3_message_kind",
    with_views("cash_msgs") + "SELECT update_id, CASE WHEN text = '/undo' THEN 'undo' ELSE 'entry' END AS kind FROM cash_msgs",
)
def _(t: Inputs):
    return messages.message_kind(t.cash_msgs).select("update_id", "kind")


_PARSED = """parsed AS (
  SELECT update_id, text, CASE WHEN text = '/undo' OR text = 'see you tonight' THEN NULL ELSE CAST(regexp_extract(text, '([0-9]+\\.[0-9]+)', 1) AS DECIMAL(18,2)) END AS size FROM cash_msgs),
events_kept AS (SELECT *, lead(text) OVER (ORDER BY update_id) AS following FROM parsed WHERE text = '/undo' OR size > 0)"""


@query(
    "t4_parse_cash_entry",
    with_views("cash_msgs", extra=(_PARSED,))
    + "SELECT update_id, CASE WHEN size > 0 THEN size END AS amount, text LIKE '+%' OR text LIKE 'received%' AS is_credit FROM parsed WHERE text <> '/undo'",
)
def _(t: Inputs):
    entries = messages.message_kind(t.cash_msgs).filter("kind = 'entry'")
    return messages.parse_cash_entry(entries).select("update_id", "amount", "is_credit")


@query(
    "t6_apply_undo",
    with_views("cash_msgs", extra=(_PARSED,))
    + "SELECT update_id, size AS amount FROM events_kept WHERE text <> '/undo' AND coalesce(following, '') <> '/undo'",
)
def _(t: Inputs):
    return messages.apply_undo(messages.cash_events(t.cash_msgs)).select("update_id", "amount")


@query(
    "s3_read_ledger",
    _LEDGER + "SELECT txn_date, description, amount, category, remarks, account FROM ledger",
)
def _(t: Inputs):
    from ledgerloom.sources.ledger import ledger_from_storage

    return ledger_from_storage(standardize.to_storage(t.ledger))


_SHOWN = "TRY_CAST(replace(replace(replace({0}, '₹', ''), '−', '-'), '%', '') AS DECIMAL(28,2))"


@query(
    "f1_display_number",
    with_views("holding_cells")
    + "SELECT tenant_id, " + ", ".join(f"{_SHOWN.format(c)} AS {c}" for c in ("invested", "value", "xirr", "profit_pct")) + " FROM holding_cells",
)
def _(t: Inputs):
    shown = [amounts.display_number(c).cast("decimal(28,2)").alias(c) for c in ("invested", "value", "xirr", "profit_pct")]
    return t.holding_cells.select("tenant_id", *shown)


@query(
    "f2_format_inr",
    with_views("holding_cells")
    + f"""SELECT tenant_id, CASE WHEN v IS NULL THEN '—'
  WHEN abs(v) >= 10000000 THEN '₹' || CAST(CAST(v / 10000000.0 AS DECIMAL(28,2)) AS STRING) || ' Cr'
  WHEN abs(v) >= 100000 THEN '₹' || CAST(CAST(v / 100000.0 AS DECIMAL(28,2)) AS STRING) || ' L'
  ELSE '₹' || format('{{:,}}', CAST(round_even(v, 0) AS BIGINT)) END AS shown
FROM (SELECT tenant_id, unnest([{_SHOWN.format('invested')}, CAST({_SHOWN.format('value')} / 1000 AS DECIMAL(28,2))]) AS v FROM holding_cells) h""",
)
def _(t: Inputs):
    thousandth = amounts.display_number("value").cast("double") / 1000
    both = F.array(amounts.display_number("invested").cast("decimal(28,2)"), amounts.rounded(thousandth, 2, "decimal(28,2)"))
    return t.holding_cells.select("tenant_id", F.explode(both).alias("v")).select("tenant_id", amounts.format_inr("v").alias("shown"))


@query(
    "f3_format_pct",
    with_views("holding_cells")
    + f"SELECT tenant_id, coalesce(CAST({_SHOWN.format('xirr')} AS STRING) || '%', '—') AS xirr, coalesce(CAST({_SHOWN.format('profit_pct')} AS STRING) || '%', '—') AS profit_pct FROM holding_cells",
)
def _(t: Inputs):
    return t.holding_cells.select("tenant_id", *[amounts.format_pct(c).alias(c) for c in ("xirr", "profit_pct")])


@query(
    "h2_days_since",
    with_views("payslips")
    + "SELECT tenant_id, period, CAST(DATE '1998-08-15' - TRY_CAST(date_of_payment AS DATE) AS INTEGER) AS days FROM payslips",
)
def _(t: Inputs):
    return t.payslips.select("tenant_id", "period", health.days_since("date_of_payment", "1998-08-15").alias("days"))


_BANKS = [
    (0, ["dd/MM/yyyy"], [r"(?P<start>\d{2}/\d{2}/\d{4}) - (?P<end>\d{2}/\d{2}/\d{4})"]),
    (1, [], [r"nothing (?P<end>x)", r"from (\d\d) until (?P<end>\S+)"]),
]


def _bank_statements(t: Inputs):
    """Statements with the date formats and period patterns of their bank."""
    settings = t.spark.createDataFrame(_BANKS, "bank int, date_formats array<string>, period_patterns array<string>")
    return t.bank_texts.withColumnRenamed("head", "text").join(F.broadcast(settings), "bank")


_ENDS = f"""ends AS (
  SELECT *, CASE WHEN trim(head) = '' OR statement_id % 5 = 0 THEN NULL
    WHEN bank = 0 THEN CAST(strptime(regexp_extract(head, '- ([0-9/]+)', 1), '%d/%m/%Y') AS DATE)
    ELSE CAST(regexp_extract(head, 'until ([0-9-]+)', 1) AS DATE) END AS printed FROM bank_texts),
dated AS (
  SELECT *, CASE WHEN coalesce(printed, period_end) IS NULL THEN DATE '{AS_OF}'
    ELSE least(CAST(coalesce(printed, period_end) + INTERVAL 5 DAY AS DATE), DATE '{AS_OF}') END AS last_date FROM ends)"""


@query("v2_no_text", with_views("bank_texts") + "SELECT statement_id FROM bank_texts WHERE trim(head) = ''")
def _(t: Inputs):
    return validate.normalised_texts(_bank_statements(t)).filter(validate.no_text()).select("statement_id")


@query("v3_statement_end", with_views("bank_texts", extra=(_ENDS,)) + "SELECT statement_id, last_date FROM dated")
def _(t: Inputs):
    ends = validate.statement_end(validate.normalised_texts(_bank_statements(t)), AS_OF)
    return ends.select("statement_id", F.col("last_date").cast("date").alias("last_date"))


@query(
    "v4_date_checks",
    with_views("bank_texts", "bank_rows", extra=(_ENDS,))
    + """SELECT statement_id, l_partkey, l_suppkey, concat_ws('; ',
  CASE WHEN r.date = 'someday' THEN 'date_unparseable:' || chr(39) || 'someday' || chr(39) END,
  CASE WHEN r.date <> 'someday' AND position(r.date IN head) = 0 THEN 'date_not_in_source:' || chr(39) || r.date || chr(39) END,
  CASE WHEN r.date <> 'someday' AND r.day > last_date THEN 'date_after_end:' || CAST(r.day AS STRING) || '>' || CAST(last_date AS STRING) END) AS reasons
FROM bank_rows r JOIN dated USING (statement_id)""",
)
def _(t: Inputs):
    ends = validate.statement_end(validate.normalised_texts(_bank_statements(t)), AS_OF)
    rows = t.bank_rows.join(ends.select("statement_id", "norm_text", "last_date", "date_formats"), "statement_id")
    reasons = F.array_join(F.array_compact(validate.date_reasons("date_formats")), "; ")
    return rows.select("statement_id", "l_partkey", "l_suppkey", reasons.alias("reasons"))


@query(
    "v5_amount_checks",
    _VALID + "SELECT statement_id, l_partkey, l_suppkey, debit, credit, concat_ws('; ', r3, r4) AS reasons FROM checked",
)
def _(t: Inputs):
    rows = validate.with_amount_reasons(t.extracted, t.stmt_text)
    reasons = F.array_join(F.array_compact("amount_reasons"), "; ")
    return rows.select("statement_id", "l_partkey", "l_suppkey", "debit", "credit", reasons.alias("reasons"))


_PRINTED = "coalesce(abs(TRY_CAST(replace({0}, '₹', '') AS DECIMAL(28,2))), 0)"
_SLIP = ("net_pay", "basic", "hra", "gsus_income")


@query(
    "p1_coerce_payslip",
    with_views("payslips") + "SELECT tenant_id, period, " + ", ".join(f"{_PRINTED.format(c)} AS {c}" for c in _SLIP) + " FROM payslips",
)
def _(t: Inputs):
    return payroll.coerce_payslip(t.payslips, _SLIP).select("tenant_id", "period", *_SLIP)


@query(
    "p2_payroll_inputs",
    with_views("payslips")
    + f"""SELECT tenant_id, period, label, CAST(round_even(value, 0) AS BIGINT) AS value FROM (
  SELECT tenant_id, period, 'Gross' AS label, {_PRINTED.format('basic')} + {_PRINTED.format('hra')} AS value FROM payslips
  UNION ALL SELECT tenant_id, period, 'Half GSU', {_PRINTED.format('gsus_income')} * 0.5 FROM payslips) p""",
)
def _(t: Inputs):
    slips = payroll.coerce_payslip(t.payslips, _SLIP).select("tenant_id", "period", *_SLIP)
    return payroll.payroll_inputs(slips, {"Gross": "basic + hra", "Half GSU": "gsus_income * 0.5"})


_MONTHS = (
    "block AS (SELECT tenant_id, CAST(year AS STRING) || '-' || m AS period, label, value FROM ("
    + " UNION ALL ".join(f"SELECT tenant_id, year, label, '{m:02d}' AS m, m{m:02d} AS value FROM payroll_grid" for m in range(1, 13))
    + ") g WHERE value IS NOT NULL)"
)
_RESIDUAL = """residuals AS (
  SELECT tenant_id, period, CAST(sum(CASE label WHEN 'GSU Value' THEN value WHEN 'Credited GSU Value' THEN -value WHEN 'Taxed GSU Value' THEN -value ELSE 0 END) AS DECIMAL(28,2)) AS residual
  FROM block GROUP BY 1, 2)"""
_GSU = ("GSU Value", "Credited GSU Value", "Taxed GSU Value")


@query(
    "p5_rounding_residual",
    with_views("payroll_grid", extra=(_MONTHS, _RESIDUAL)) + "SELECT tenant_id, period, residual FROM residuals",
)
def _(t: Inputs):
    return payroll.rounding_residual(payroll.payroll_block(t.payroll_grid), *_GSU)


@query(
    "p6_net_pay_guard",
    with_views("payroll_grid", "payslips", extra=(_MONTHS, _RESIDUAL))
    + f""", sums AS (
  SELECT tenant_id, period, sum(CASE WHEN label = 'Total Salary' THEN value ELSE -value END) AS s FROM block
  WHERE abs(value) >= 0.5 AND label IN ('Total Salary', 'Total Tax', 'Small Savings') GROUP BY 1, 2),
d AS (
  SELECT p.tenant_id, p.period, {_PRINTED.format('net_pay')} AS net, coalesce(s, 0) - coalesce(residual, 0) - {_PRINTED.format('net_pay')} AS difference
  FROM payslips p LEFT JOIN sums USING (tenant_id, period) LEFT JOIN residuals USING (tenant_id, period))
SELECT tenant_id, period, CAST(difference AS DECIMAL(28,2)) AS difference, abs(difference) <= greatest(1, 0.001 * abs(net)) AS accepted FROM d""",
)
def _(t: Inputs):
    block = payroll.payroll_block(t.payroll_grid)
    slips = payroll.coerce_payslip(t.payslips, ["net_pay"])
    return payroll.net_pay_guard(payroll.split_payroll(block, _SPLITS), slips, payroll.rounding_residual(block, *_GSU))
