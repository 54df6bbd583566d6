"""Statement catalogue."""

from pyspark.sql import functions as F

from ledgerloom.checks.fragments import SPLIT, with_views
from ledgerloom.checks.registry import query
from ledgerloom.checks.views import Inputs
from ledgerloom.operators import catalog, guard
from ledgerloom.session import shared_folder
from ledgerloom.sources.rules import parsing_configs
from ledgerloom.sources.statements import list_statements, read_statement_rows

CONFIGURED = [f"{k}-brand{i}" for k in ("bank", "cc") for i in range(1, 21)]
MAIL_CONFIGS = [
    {"subject": "Bank Statement", "from": "statements@bank.example", "prefix": "bank-a"},
    {"subject": "credit card", "to": "user1@", "prefix": "cc-b"},
    {"subject": "your bank", "prefix": "bank-c"},
]
SINCE = "1996-06-01"

_KINDS = """kinds AS (
  SELECT f.*, k.kind FROM files f, unnest(['bank', 'cc']) AS k(kind) WHERE contains(lower(f.file_name), k.kind)),
accounts AS (SELECT DISTINCT account, split_part(account, '-', 1) AS kind FROM ledger),
named AS (
  SELECT k.file_id, k.kind, k.file_name, arg_max(a.account, length(a.account)) AS account
  FROM kinds k JOIN accounts a ON a.kind = k.kind AND contains(lower(k.file_name), lower(a.account)) GROUP BY 1, 2, 3),
parts AS (
  SELECT *, string_split(regexp_replace(split_part(lower(file_name), '.', 1), '_copy[0-9]+$', ''), '-') AS p FROM named),
periods AS (
  SELECT file_id, kind, file_name, account,
         CASE WHEN regexp_full_match(p[-2], '[0-9]{4}') AND regexp_full_match(p[-1], '[0-9]{2}')
              THEN last_day(TRY_CAST(p[-2] || '-' || p[-1] || '-01' AS DATE))
              WHEN kind = 'bank' AND regexp_full_match(p[-1], '[0-9]{4}') THEN TRY_CAST(p[-1] || '-12-31' AS DATE) END AS period_end
  FROM parts),
firsts AS (
  SELECT file_id, kind, file_name, account, period_end FROM (
    SELECT *, row_number() OVER (PARTITION BY account, period_end ORDER BY file_name, file_id) AS rk FROM periods) x
  WHERE rk = 1 OR period_end IS NULL)"""
_BASE = with_views("files", "ledger", "processed", extra=(_KINDS,))
_WATERMARK = f"(SELECT account, max(txn_date) AS latest FROM ledger WHERE txn_date < {SPLIT} AND account NOT LIKE '%brand7' GROUP BY 1)"


def _watermark(t: Inputs):
    return guard.latest_by_account(t.history.filter(~F.col("account").endswith("brand7")))


def _periods(t: Inputs):
    return catalog.statement_period_end(catalog.resolve_account(catalog.files_of_type(t.files), t.accounts))


@query("c1_resolve_account", _BASE + "SELECT file_id, kind, account FROM named")
def _(t: Inputs):
    return catalog.resolve_account(catalog.files_of_type(t.files), t.accounts).select("file_id", "kind", "account")


@query("c2_statement_period_end", _BASE + "SELECT file_id, kind, period_end FROM periods")
def _(t: Inputs):
    return _periods(t).select("file_id", "kind", "period_end")


@query("c3_files_of_type", _BASE + "SELECT file_id, file_name, kind FROM kinds")
def _(t: Inputs):
    return catalog.files_of_type(t.files)


@query("c4_dedup_statements", _BASE + "SELECT file_id, account, period_end FROM firsts")
def _(t: Inputs):
    return catalog.dedup_statements(_periods(t)).select("file_id", "account", "period_end")


@query(
    "c5_skip_covered",
    _BASE + f"SELECT f.file_id, f.account, f.period_end FROM firsts f LEFT JOIN {_WATERMARK} w USING (account) "
    "WHERE w.latest IS NULL OR f.period_end IS NULL OR w.latest < f.period_end",
)
def _(t: Inputs):
    return catalog.skip_covered(catalog.dedup_statements(_periods(t)), _watermark(t)).select(
        "file_id", "account", "period_end"
    )


@query(
    "c6_skip_processed",
    _BASE + f"SELECT f.file_id, f.account, f.period_end FROM firsts f LEFT JOIN {_WATERMARK} w USING (account) "
    "LEFT JOIN processed p ON p.file_id = f.file_id "
    "WHERE w.latest IS NULL OR p.max_txn_date IS NULL OR w.latest < p.max_txn_date",
)
def _(t: Inputs):
    return catalog.skip_processed(
        catalog.dedup_statements(_periods(t)), t.processed, _watermark(t)
    ).select("file_id", "account", "period_end")


def _configs(t: Inputs):
    return parsing_configs(t.spark, {k: {"column_map": {"Date": "date"}} for k in CONFIGURED})


@query(
    "c7_route_config",
    _BASE + "SELECT file_id, account, kind || '-' || split_part(account, '-', 2) AS config_key FROM firsts "
    f"WHERE kind || '-' || split_part(account, '-', 2) IN ({', '.join(repr(k) for k in CONFIGURED)})",
)
def _(t: Inputs):
    return catalog.route_config(catalog.dedup_statements(_periods(t)), _configs(t)).select(
        "file_id", "account", "config_key"
    )


@query(
    "c8_update_processed",
    with_views("processed", "ledger")
    + """, rows_read AS (SELECT l_orderkey AS file_id, CAST(l_shipdate AS DATE) AS txn_date, l_suppkey FROM lineitem),
fresh AS (SELECT file_id, max(txn_date) AS max_txn_date FROM rows_read
          WHERE file_id NOT IN (SELECT file_id FROM rows_read WHERE l_suppkey % 7 = 0) GROUP BY 1)
SELECT coalesce(f.file_id, p.file_id) AS file_id, coalesce(f.max_txn_date, p.max_txn_date) AS max_txn_date
FROM fresh f FULL JOIN processed p ON p.file_id = f.file_id""",
)
def _(t: Inputs):
    rows = t.table("lineitem").select(
        F.col("l_orderkey").alias("file_id"), F.col("l_shipdate").cast("date").alias("txn_date"), "l_suppkey"
    )
    return catalog.update_processed(rows.drop("l_suppkey"), rows.filter("l_suppkey % 7 = 0"), t.processed)


_HITS = f"""hits AS (
  SELECT m.*, 0 AS config_idx, 'bank-a' AS prefix FROM mails m WHERE contains(lower(subject), 'bank statement') AND contains(sender, 'statements@bank.example')
  UNION ALL SELECT m.*, 1, 'cc-b' FROM mails m WHERE contains(lower(subject), 'credit card') AND contains(recipient, 'user1@')
  UNION ALL SELECT m.*, 2, 'bank-c' FROM mails m WHERE contains(lower(subject), 'your bank')),
wanted AS (SELECT * FROM hits WHERE has_attachment AND NOT in_trash AND NOT processed AND received_at > DATE '{SINCE}'),
based AS (
  SELECT *, prefix || '-' || strftime(CASE WHEN day(received_at) < 15 THEN received_at - 20 ELSE received_at END, '%Y-%m') || '.pdf' AS base_name
  FROM wanted)"""


def _mails(t: Inputs):
    return catalog.select_statement_mails(t.mails, MAIL_CONFIGS, SINCE)


@query("c9_select_statement_mails", with_views("mails", extra=(_HITS,)) + "SELECT mail_id, config_idx, prefix FROM wanted")
def _(t: Inputs):
    return _mails(t).select("mail_id", "config_idx", "prefix")


@query("c10_infer_statement_name", with_views("mails", extra=(_HITS,)) + "SELECT mail_id, config_idx, base_name FROM based")
def _(t: Inputs):
    return catalog.infer_statement_name(_mails(t)).select("mail_id", "config_idx", "base_name")


@query(
    "c11_assign_copy_names",
    with_views("mails", "stored_names", extra=(_HITS,))
    + """, cand AS (
  SELECT base_name, mail_id, config_idx, row_number() OVER (PARTITION BY base_name ORDER BY received_at, mail_id, config_idx) AS k FROM based),
names AS (
  SELECT b.base_name, i AS number,
         CASE WHEN i = 0 THEN b.base_name ELSE regexp_replace(b.base_name, '[.]pdf$', '_copy' || i || '.pdf') END AS file_name
  FROM (SELECT base_name, count(*) AS n FROM cand GROUP BY 1) b, unnest(generate_series(0, n + 10)) AS u(i)),
free AS (
  SELECT *, row_number() OVER (PARTITION BY base_name ORDER BY number) AS k FROM names
  WHERE file_name NOT IN (SELECT file_name FROM stored_names))
SELECT c.mail_id, c.config_idx, c.base_name, f.file_name FROM cand c JOIN free f USING (base_name, k)""",
)
def _(t: Inputs):
    named = catalog.infer_statement_name(_mails(t))
    return catalog.assign_copy_names(named, t.stored_names).select("mail_id", "config_idx", "base_name", "file_name")


FILE_ROWS = 5000


def _written_statements(t: Inputs) -> str:
    """Statement grids of the tables as CSV files in the shared folder, of at most ``FILE_ROWS`` rows each."""
    where = shared_folder(t.spark, "statements")
    t.stmt_cells.select(
        F.col("statement_id").cast("string"), "date_text",
        F.concat("description", F.lit(',\n"x"')).alias("description"), "amount_text",
    ).write.option("maxRecordsPerFile", FILE_ROWS).csv(where, escape='"')
    return where


@query(
    "s1_list_statements",
    with_views("stmt_cells")
    + """SELECT CAST(statement_id % 7 AS STRING) AS folder, count(DISTINCT statement_id // 5000) AS files FROM stmt_cells GROUP BY 1""",
)
def _(t: Inputs):
    # A file for each folder and 5,000 statement numbers: tasks stay small and the listing grows.
    where, run = shared_folder(t.spark, "statement-folders"), F.floor(F.col("statement_id") / 5000)
    rows = t.stmt_cells.select("description", "amount_text", (F.col("statement_id") % 7).alias("folder"), run.alias("run"))
    rows.repartition("folder", "run").write.partitionBy("folder", "run").csv(where)
    files = list_statements(t.spark, where).filter(F.col("file_name").endswith(".csv") & (F.col("length") > 0))
    return files.groupBy(F.regexp_extract("file_id", "folder=([^/]*)/", 1).alias("folder")).agg(F.count("*").alias("files"))


@query(
    "s2_read_statement_rows",
    with_views("stmt_cells")
    + "SELECT CAST(statement_id AS STRING) AS c0, date_text AS c1, description || ',' || chr(10) || '\"x\"' AS c2, amount_text AS c3 FROM stmt_cells",
)
def _(t: Inputs):
    rows = read_statement_rows(t.spark, _written_statements(t))
    return rows.select(*[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(4)])
