"""Composite jobs."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import cash, catalog, category_index, dedup, guard, health
from ledgerloom.operators import messages as msg
from ledgerloom.operators import payroll, standardize, summary, validate
from ledgerloom.operators.categorize import categorize, suggest_rules, vocabulary
from ledgerloom.plans.booking import Books
from ledgerloom.schema import CASH_STORAGE, DEFAULT_CATEGORY, REVIEW, TXN, TXN_COLUMNS
from ledgerloom.sources.ledger import LedgerStore, TableStore, cash_history
from ledgerloom.sources.statements import list_statements, plain_path, read_statement_rows

log = logging.getLogger(__name__)

PROCESSED = T.StructType(
    [T.StructField("file_id", T.StringType()), T.StructField("max_txn_date", T.DateType())]
)
PENDING = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("file_id", "file_name", "kind", "account", "config_key")]
    + [T.StructField("period_end", T.DateType())]
)
PARSED = T.StructType([T.StructField("file_id", T.StringType()), *TXN.fields])
FILES_PER_READ = 10_000
FETCH_LOG = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("attempt_date", T.DateType()),
        T.StructField("new_count", T.LongType()),
    ]
)
BACKUP = T.StructType([*TXN.fields, T.StructField("id", T.StringType())])


@dataclass
class Rules:
    accounts: DataFrame
    configs: DataFrame
    matchers: Sequence[dict]
    ignore: Sequence[dict] = field(default_factory=list)
    mirror: dict[str, str] = field(default_factory=dict)

    def mirror_rows(self, store: LedgerStore, booked: DataFrame) -> None:
        """M1-M4 for a booked batch; rows whose marker the cash ledger holds add nothing."""
        if self.mirror:
            bank_rows = booked.filter(dedup.ledger_kind("account") == "bank")
            store.append("cash", cash.mirror_cash(bank_rows, self.mirror, store.read("cash", CASH_STORAGE)))


@dataclass
class Extracted:
    """Rows, texts and printed totals of extracted (PDF) statements; ``statement_id`` is the file id."""

    rows: DataFrame
    statements: DataFrame
    summaries: DataFrame | None = None


def pending_files(
    files: DataFrame, rules: Rules, watermark: DataFrame, processed: DataFrame
) -> DataFrame:
    """The statements worth reading, decided before any content is read."""
    named = catalog.resolve_account(catalog.files_of_type(files), rules.accounts)
    periods = catalog.dedup_statements(catalog.statement_period_end(named))
    left = catalog.skip_processed(catalog.skip_covered(periods, watermark), processed, watermark)
    return catalog.route_config(left, rules.configs)


def read_grids(spark: SparkSession, store: LedgerStore, pending: DataFrame, rules: Rules, as_of: str) -> DataFrame:
    """S2, A1-A16 of the pending ``.csv`` files, in groups of about ``FILES_PER_READ`` files."""
    grids = pending.filter(F.lower("file_name").endswith(".csv"))
    groups = max(1, -(-grids.select("file_id").distinct().count() // FILES_PER_READ))
    store.replace("parsed", spark.createDataFrame([], PARSED))
    for n in range(groups):
        part = grids.filter(F.pmod(F.xxhash64("file_id"), F.lit(groups)) == n)
        paths = [r.file_id for r in part.select("file_id").distinct().collect()]  # one group's names
        if paths:
            rows = read_statement_rows(spark, paths).withColumn("file_id", plain_path(F.col("file_id")))
            good = standardize.accepted(standardize.parse_statements(rows, part, rules.configs, as_of))
            store.append("parsed", good.select(*PARSED.fieldNames()))
    return store.read("parsed", PARSED)


def read_extracted(
    store: LedgerStore, pending: DataFrame, extracted: Extracted, rules: Rules, as_of: str
) -> tuple[DataFrame, DataFrame]:
    """N6 for the pending ``.pdf`` files: (parsed rows, files without a flagged row).

    Each statement is checked with the date formats and period patterns of its own
    configuration. Review rows the surface does not hold yet are appended (L8).
    """
    files = pending.filter(F.lower("file_name").endswith(".pdf")).withColumnRenamed("file_id", "statement_id")
    settings = rules.configs.select("config_key", "date_formats", F.col("statement_period_patterns").alias("period_patterns"))
    own = files.select("statement_id", "config_key", "period_end").join(settings, "config_key").drop("config_key")
    statements = extracted.statements.select("statement_id", "text").join(own, "statement_id")
    rows = extracted.rows.join(files.select("statement_id"), "statement_id", "left_semi")
    checked = store.rewrite("checked", validate.best_attempt(validate.validate_rows(rows, statements, as_of)))
    flags = validate.statement_flags(checked, statements, extracted.summaries)
    named = files.select("statement_id", "account", "file_name")
    review = validate.review_rows(checked, flags, named).select(*REVIEW.fieldNames())
    store.append("review", review.exceptAll(store.read("review", REVIEW)))
    txns = standard_rows(validate.passed(checked), named, statements, as_of)
    clean = checked.groupBy("statement_id").agg(F.max(F.size("reasons")).alias("worst")).filter("worst = 0")
    return txns.select(*PARSED.fieldNames()), clean.select(F.col("statement_id").alias("file_id"))


def standard_rows(rows: DataFrame, files: DataFrame, settings: DataFrame, as_of: str) -> DataFrame:
    """A6-A12 over passed extracted rows; dates by their statement's formats, then ISO."""
    formats = F.concat(F.coalesce("date_formats", F.array().cast("array<string>")), F.array(F.lit(validate.ISO_PATTERN)))
    good = rows.join(settings.select("statement_id", formats.alias("_formats")), "statement_id").join(
        files.select("statement_id", "account"), "statement_id"
    )
    dated = standardize.parse_dates(good, "date", F.col("_formats"))
    signed = dated.withColumn("amount", standardize.signed_amount(F.col("debit"), F.col("credit")))
    known = standardize.drop_future(signed.filter("amount IS NOT NULL"), as_of)
    return known.select(
        F.col("statement_id").alias("file_id"), "txn_date", "description", "amount",
        F.lit(DEFAULT_CATEGORY).alias("category"), F.lit("").alias("remarks"), "account",
    )


def incremental_ingest(
    spark: SparkSession, store: LedgerStore, statements_path: str, rules: Rules, as_of: str,
    extracted: Extracted | None = None, predictions: DataFrame | None = None,
) -> DataFrame:
    """Reads pending statements and appends what is new, categorised, per ledger.

    ``.csv`` files are read as grids; for ``.pdf`` files ``extracted`` holds the rows read
    from them, which are validated first (N6). Extracted statements without a flagged row
    are remembered with their newest day (C8), so that later runs skip them. ``predictions``
    are labels (norm, is_debit, category) of a scorer for rows no layer settles (K19).

    The labelled batch is written once and booked from that table, so nothing is computed
    twice and a run cut short is finished by the next one.
    """
    books = Books(store).open()
    processed = store.read("processed", PROCESSED)
    listed = list_statements(spark, statements_path).withColumn("file_id", plain_path(F.col("file_id")))
    pending = pending_files(listed, rules, books.watermark(), processed)
    pending = store.rewrite("pending", pending.select(*PENDING.fieldNames()))
    parsed, done = read_grids(spark, store, pending, rules, as_of), None
    if extracted is not None:
        rows, clean = read_extracted(store, pending, extracted, rules, as_of)
        store.append("parsed", rows)
        parsed = store.read("parsed", PARSED)
        fresh = parsed.join(clean, "file_id", "left_semi")
        done = catalog.update_processed(fresh, parsed.limit(0), processed)
    booked = books.ingest(parsed, rules.matchers, rules.ignore, predictions)
    rules.mirror_rows(store, booked)
    if done is not None:
        store.replace("processed", done.select(*PROCESSED.fieldNames()))
    return booked.groupBy(dedup.ledger_kind("account").alias("ledger"), "source").agg(F.count("*").alias("rows"))


def recategorize_job(store: LedgerStore, matchers: Sequence[dict]) -> dict[str, int]:
    """Guard, then fresh labels for unlabelled rows, then verified rewrites of their months."""
    books = Books(store).open()  # a batch cut short belongs to the ledgers
    everything = store.read_all()
    backup = store.read("backup", BACKUP) if store.location("backup") else None
    guard.assert_safe(guard.check_overwrite(everything, backup, require_baseline=True))
    month = F.date_format("txn_date", "yyyy-MM")
    months = [r[0] for r in dedup.uncategorised(everything).select(month).distinct().collect()]
    if not months:
        return {}
    touched = guard.recategorize(everything, matchers).filter(month.isin(months))
    return books.rewrite(store.rewrite("recategorized", touched.select(*TXN_COLUMNS)))


def learn_rules(store: LedgerStore) -> DataFrame:
    """N3"""
    return suggest_rules(store.read_all())


def backup_job(store: LedgerStore) -> int:
    """Upserts both ledgers into the backup."""
    old = store.read("backup", BACKUP) if store.location("backup") else None
    return store.replace("backup", guard.backup_upsert(store.read_all(), old).select(*BACKUP.fieldNames()))


def restore_job(store: LedgerStore) -> dict[str, int]:
    """Both ledgers rewritten from the backup."""
    backup = store.read("backup", BACKUP)
    rows = guard.restore(backup)
    guard.assert_safe(guard.check_overwrite(rows, backup, require_baseline=False))
    Books(store).open()
    written = {k: store.overwrite_ledger(k, rows.filter(F.col("ledger") == k)) for k in ("bank", "cc")}
    Books(store).open()
    return written


def daily(
    spark: SparkSession, store: LedgerStore, statements_path: str, rules: Rules, as_of: str,
    new_files: int, tenant: str = "default",
) -> DataFrame:
    """Ingest, fetch log entry, health verdict; an ingest error becomes part of it."""
    entry = spark.createDataFrame([(tenant, None, new_files)], "tenant_id string, attempt_date date, new_count long")
    store.append("fetch_log", entry.withColumn("attempt_date", F.lit(as_of).cast("date")))
    error = None
    try:
        incremental_ingest(spark, store, statements_path, rules, as_of)
    except Exception as e:  # reported in the verdict, and whole in the log
        log.exception("ingest failed")
        error = str(e).split("\n")[0]
    latest = guard.latest_overall(store.read_all()).select(
        F.lit(tenant).alias("tenant_id"), "latest", F.lit(error).cast("string").alias("pipeline_error"),
        F.lit(new_files).cast("long").alias("new_count"),
    )
    return health.evaluate_health(latest, health.fetch_status(store.read("fetch_log", FETCH_LOG)), as_of)


def validate_extracted(
    extracted: DataFrame, statements: DataFrame, summaries: DataFrame, files: DataFrame, as_of: str,
    formats: Sequence[str] = (), period_patterns: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(standard transactions of passed rows, review rows) of the best attempts.

    ``files(statement_id, account, file_name)``. Statements with columns ``date_formats``
    and ``period_patterns`` follow their own settings, others the ones given here.
    """
    statements = validate.with_settings(statements, formats, period_patterns)
    checked = validate.best_attempt(validate.validate_rows(extracted, statements, as_of))
    flags = validate.statement_flags(checked, statements, summaries)
    review = validate.review_rows(checked, flags, files).select(*REVIEW.fieldNames())
    return standard_rows(validate.passed(checked), files, statements, as_of).select(*TXN_COLUMNS), review


def payroll_split(
    payslips: DataFrame, block: DataFrame, ledger: DataFrame, split_map: dict[str, dict], account: str,
    rounding: tuple[str, str, str] | None = None, employer: str = "Employer",
) -> tuple[DataFrame, DataFrame]:
    """(ledger rows of accepted unsplit periods, guard verdicts)."""
    todo = payroll.unsplit_periods(payslips, ledger, employer)
    wanted = block.join(todo, ["tenant_id", "period"], "left_semi")
    broken = payroll.missing_labels(wanted, split_map).select("tenant_id", "period").distinct()
    splits = payroll.split_payroll(wanted, split_map).join(broken, ["tenant_id", "period"], "left_anti")
    residual = payroll.rounding_residual(wanted, *rounding) if rounding else None
    verdicts = payroll.net_pay_guard(
        splits, payslips.join(todo, ["tenant_id", "period"], "left_semi"), residual
    )
    good = splits.join(verdicts.filter("accepted"), ["tenant_id", "period"], "left_semi")
    return payroll.ledger_rows(good, payslips, account, employer), verdicts


def cash_intake(
    messages: DataFrame, chat_id: int, users: dict[int, str], stored_cash: DataFrame, matchers: Sequence[dict]
) -> DataFrame:
    """N8 in batch form: cash ledger rows of the messages that stand."""
    kept = msg.apply_undo(msg.cash_events(msg.authorised(messages, chat_id, users)))
    return label_cash(msg.cash_transactions(kept), stored_cash, matchers)


def label_cash(
    entries: DataFrame, stored_cash: DataFrame, matchers: Sequence[dict], *keep: str, index: category_index.CategoryIndex | None = None
) -> DataFrame:
    """T5: categories from cash history; the sender's label replaces the review remark.

    ``index`` is the stored index of that history, where the caller keeps one.
    """
    done = categorize(entries, index or category_index.build_index(cash_history(stored_cash), "global"), matchers)
    stored = standardize.to_storage(done.withColumn("remarks", F.coalesce("label", F.lit(""))), *keep)
    return stored.drop("Account")


def summary_feed(grid: DataFrame, held: DataFrame, as_of: str, updated: str, path: str) -> str:
    """One JSON line per tenant, published whole; returns the folder to read.

    Each feed is a generation beside the last one. A marker file, made in one step, makes
    it the current one, and only then does the last one go: a reader that asks
    ``current_feed`` finds a whole feed at any moment, also after a crash.
    """
    record = summary.summary_record(summary.holdings(held), summary.annual_figures(grid, as_of), updated)
    store, name = _feed_store(record.sparkSession, path)
    store.publish_json(name, record)
    return store.location(name)


def _feed_store(spark: SparkSession, path: str) -> tuple[TableStore, str]:
    root, _, name = path.rstrip("/").rpartition("/")
    return TableStore(spark, root), name


def current_feed(spark: SparkSession, path: str) -> str | None:
    """Folder of the newest whole feed below ``path``; None before the first one."""
    store, name = _feed_store(spark, path)
    return store.location(name)


def cash_vocabulary(stored_cash: DataFrame, matchers: Sequence[dict]) -> DataFrame:
    return vocabulary(cash_history(stored_cash), matchers)
