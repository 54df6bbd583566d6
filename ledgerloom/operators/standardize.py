"""Statement grids to standard transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import parse_amount
from ledgerloom.functions.dates import bind, parse_timestamp
from ledgerloom.functions.text import as_col, is_blank, text_or_empty
from ledgerloom.schema import AMOUNT, CANONICAL_ORDER, DEFAULT_CATEGORY

# Fixed values of the statement formats.
HEADER_SEARCH_ROWS = 30
HEADER_MATCH_SHARE = 0.75
TILDE_PACKED = "hdfc_cc_tilde"
TARGETS = ["date", "description", "debit", "credit", "amount", "category", "remarks", "account"]


def with_configs(files: DataFrame, configs: DataFrame) -> DataFrame:
    """Each file's settings beside it.

    The configurations are the small side: dealt by their few keys, all files would meet in as many tasks.
    """
    return files.join(F.broadcast(configs), "config_key")


def detect_header(rows: DataFrame, files: DataFrame, configs: DataFrame) -> DataFrame:
    """A1: header row of each file and its cells; row 0 when no pattern fits.

    ``rows(file_id, row_no, cells)``; ``files(file_id, config_key, ...)``;
    ``configs(config_key, header_patterns, ...)``. Only the first 30 rows of a file take part.
    """

    def fits(line: Column, pattern: Column) -> Column:
        hits = F.size(F.filter(pattern, lambda w: line.contains(F.lower(w))))
        return hits >= F.size(pattern) * F.lit(HEADER_MATCH_SHARE)

    def fits_any(line: Column) -> Column:
        return F.exists("header_patterns", lambda p: fits(line, p))

    # Rows meet their file's key; the patterns come beside them afterwards and are gone before any sort.
    keyed = rows.filter(F.col("row_no") < HEADER_SEARCH_ROWS).join(files.select("file_id", "config_key"), "file_id")
    head = with_configs(keyed, configs.select("config_key", "header_patterns"))
    hit = F.when(bind(F.lower(F.array_join("cells", " ", "")), fits_any), F.col("row_no"))
    return head.select("file_id", "row_no", "cells", hit.alias("hit")).groupBy("file_id").agg(
        F.coalesce(F.min("hit"), F.lit(0)).alias("header_row"),
        F.coalesce(F.min_by("cells", "hit"), F.min_by("cells", "row_no")).alias("header"),
    )


def unpack_tilde_header(headers: DataFrame) -> DataFrame:
    """A3 for the header: ``~``-packed first cell to cells, where the format says so."""
    return headers.withColumn(
        "header",
        F.when(F.col("special_handling") == TILDE_PACKED, F.split(text_or_empty(F.get("header", F.lit(0))), "~"))
        .otherwise(F.col("header")),
    )


def unpack_tilde(records: DataFrame) -> DataFrame:
    """A3: splits packed rows and keeps those with as many fields as the header."""
    packed = F.coalesce(F.col("special_handling") == TILDE_PACKED, F.lit(False))
    return records.withColumn(
        "cells", F.when(packed, F.split(text_or_empty(F.get("cells", F.lit(0))), "~")).otherwise(F.col("cells"))
    ).filter(~packed | (F.size("cells") == F.size("header")))


def rows_to_records(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """A2: the rows after each file's header, beside the header cells."""
    return rows.join(headers, "file_id").filter(F.col("row_no") > F.col("header_row"))


def clean_cells(records: DataFrame) -> DataFrame:
    """A4: blank cells to NULL, rows without any value dropped.

    A column the header names stays even if the whole file leaves it blank. Without this
    a month with debits only would have no credit column and so no readable amount.
    """
    # The row test reads the cells as they are: on the cleaned ones it would clean them twice.
    return records.filter(F.exists("cells", lambda c: ~is_blank(c))).withColumn(
        "cells", F.transform("cells", lambda c: F.when(~is_blank(c), c))
    )


def _position(name: Column, cells: Column) -> Column:
    """1-based position of a name among reduced header cells, given last first; NULL when absent."""
    return bind(
        F.array_position(cells, F.lower(F.trim(name))), lambda at: F.when(at > 0, (F.size(cells) - at + 1).cast("int"))
    )


def map_columns(headers: DataFrame) -> DataFrame:
    """A5: where each target column sits in a file, resolved once per file.

    Needs ``header`` and ``column_map``; adds ``at`` (target -> cell position) and the
    position of the sign column.
    """
    reduced = F.reverse(F.transform("header", lambda h: F.lower(F.trim(text_or_empty(h)))))
    found = bind(
        reduced,
        lambda cells: F.transform(
            F.map_entries("column_map"),
            lambda e: F.struct(e["value"].alias("target"), _position(e["key"], cells).alias("position")),
        ),
    )

    def position_of(target: Column) -> Column:
        return F.array_max(F.transform("_found", lambda e: F.when(e["target"] == target, e["position"])))

    at = F.struct(*[position_of(F.lit(t)).alias(t) for t in TARGETS])
    return (
        headers.withColumn("_found", found)
        .withColumn("at", at)
        .withColumn("sign_at", position_of(F.col("amount_sign_col")))
        .drop("_found")
    )


def cell(position: Column | str, cells: Column | str = "cells") -> Column:
    p = as_col(position)
    return F.when(p.isNotNull(), F.get(cells, p - 1))


def indicator_amount(amount: Column, indicator: Column, debit_value: Column) -> Column:
    """Negated where the indicator says debit (an empty setting means no text)."""
    wanted = F.lower(text_or_empty(debit_value))
    is_debit = F.when(indicator.isNull(), wanted == "").otherwise(F.lower(F.trim(indicator)) == wanted)
    return F.when(is_debit, -amount).otherwise(amount)


def signed_amount(debit: Column, credit: Column) -> Column:
    """A8"""
    return (parse_amount(credit) - parse_amount(debit)).cast(AMOUNT)


def standardize(records: DataFrame, as_of: str | None = None) -> DataFrame:
    """A6-A12 and A16 over mapped records; problems become ``reject_reason``.

    Row problems reject the row, statement problems (no date or amount column) reject
    every row of the file; other files are untouched.
    """
    at = F.col("at")
    paired = at["debit"].isNotNull() & at["credit"].isNotNull()
    mode = (
        F.when(paired, "debit_credit")
        .when(at["amount"].isNotNull() & F.col("sign_at").isNotNull(), "indicator")
        .when(at["amount"].isNotNull(), "plain")
    )

    def signed(cells: Column) -> Column:
        amount = parse_amount(cell(at["amount"], cells))
        return (
            F.when(F.col("amount_mode") == "debit_credit", signed_amount(cell(at["debit"], cells), cell(at["credit"], cells)))
            .when(F.col("amount_mode") == "indicator", indicator_amount(amount, cell("sign_at", cells), F.col("debit_value")))
            .when(F.col("amount_mode") == "plain", amount)
        )

    def reason(ts: Column, amount: Column) -> Column:
        found = (
            F.when(at["date"].isNull(), "statement: no date column")
            .when(F.col("amount_mode").isNull(), "statement: no amount column")
            .when(ts.isNull(), "row: unreadable date")
            .when(amount.isNull(), "row: unreadable amount")
        )
        return found if as_of is None else found.when(ts > F.lit(as_of).cast("timestamp_ntz"), "row: future date")

    def typed(cells: Column) -> Column:
        ts = parse_timestamp(cell(at["date"], cells), F.col("date_formats"))
        return bind(
            F.struct(ts.alias("ts"), signed(cells).alias("amount")),
            lambda r: F.struct(r["ts"].alias("ts"), r["amount"].alias("amount"), reason(r["ts"], r["amount"]).alias("reason")),
        )

    # Date, amount and reason are one value of the cells: a filter on the reason reads each cell once.
    read = bind(F.col("cells"), typed)
    out = records.withColumn("amount_mode", mode).withColumn("_read", read)
    ts = F.col("_read.ts")
    known = [c for c in ("account",) if c in records.columns]
    return out.select(
        "file_id",
        "row_no",
        ts.cast("date").alias("txn_date"),
        ts.alias("ts"),
        text_or_empty(cell(at["description"])).alias("description"),
        F.col("_read.amount").alias("amount"),
        F.coalesce(cell(at["category"]), F.lit(DEFAULT_CATEGORY)).alias("category"),
        text_or_empty(cell(at["remarks"])).alias("remarks"),
        F.coalesce(*[F.col(c) for c in known], cell(at["account"]), F.lit("Unknown")).alias("account"),
        F.col("_read.reason").alias("reject_reason"),
    )


def parse_statements(
    rows: DataFrame, files: DataFrame, configs: DataFrame, as_of: str | None = None
) -> DataFrame:
    """A1-A12, A16 for all files in one plan.

    ``files(file_id, account, config_key)``; ``configs`` has the PARSING_CONFIG schema
    with translated date patterns.
    """
    named = files.select("file_id", "account", "config_key")
    found = detect_header(rows, named, configs).join(named, "file_id")
    headers = map_columns(unpack_tilde_header(with_configs(found, configs))).select(
        "file_id", "account", "header_row", "header", "special_handling", "date_formats", "debit_value", "at", "sign_at"
    )
    records = clean_cells(unpack_tilde(rows_to_records(rows, headers)))
    return standardize(records, as_of)


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reject_reason IS NULL").drop("reject_reason")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reject_reason IS NOT NULL")


def reject_summary(parsed: DataFrame) -> DataFrame:
    """Rejected rows per file and reason with the latest date among them."""
    # The test is on an aggregate: on a grouping key it would move below and parse every row twice.
    found = parsed.groupBy("file_id", "reject_reason").agg(
        F.count("*").alias("rows"), F.max("txn_date").alias("latest"), F.count("reject_reason").alias("_rejected")
    )
    return found.filter("_rejected > 0").drop("_rejected")


def parse_dates(df: DataFrame, source: str, formats, target: str = "txn_date") -> DataFrame:
    """Parses a text column; rows without a readable date drop."""
    return df.withColumn(target, parse_timestamp(source, formats).cast("date")).filter(F.col(target).isNotNull())


def drop_future(df: DataFrame, as_of: str, column: str = "txn_date") -> DataFrame:
    """A12"""
    return df.filter(F.col(column) <= F.lit(as_of).cast("date"))


def after_watermark(df: DataFrame, watermark: DataFrame, inclusive: bool = False) -> DataFrame:
    """Rows strictly newer than the latest ledger date of their account.

    ``inclusive`` keeps same-day rows as well, for use before duplicate elimination.
    """
    newer = F.col("txn_date") >= F.col("latest") if inclusive else F.col("txn_date") > F.col("latest")
    return df.join(watermark, "account", "left").filter(F.col("latest").isNull() | newer).drop("latest")


def canonical_sort(df: DataFrame) -> DataFrame:
    """Total order for sinks."""
    return df.orderBy(*[c for c in CANONICAL_ORDER if c in df.columns])


def conform(df: DataFrame) -> DataFrame:
    """Target columns in fixed order with defaults for missing ones."""
    defaults = {
        "txn_date": F.lit(None).cast("date"),
        "description": F.lit(""),
        "amount": F.lit(0).cast(AMOUNT),
        "category": F.lit(DEFAULT_CATEGORY),
        "remarks": F.lit(""),
        "account": F.lit("Unknown"),
    }
    return df.select(*[F.col(c) if c in df.columns else d.alias(c) for c, d in defaults.items()])


def to_storage(df: DataFrame, *keep: str) -> DataFrame:
    """Transactions to the seven text columns of a stored ledger, plus columns to keep."""
    amount = F.col("amount")
    return df.select(
        F.coalesce(F.date_format("txn_date", "yyyy-MM-dd"), F.lit("")).alias("Date"),
        text_or_empty("description").alias("Description"),
        F.when(amount < 0, (-amount).cast("string")).otherwise("").alias("Debit"),
        F.when(amount >= 0, amount.cast("string")).otherwise("").alias("Credit"),
        F.coalesce("category", F.lit(DEFAULT_CATEGORY)).alias("Category"),
        text_or_empty("remarks").alias("Remarks"),
        F.coalesce("account", F.lit("Unknown")).alias("Account"),
        *keep,
    )
