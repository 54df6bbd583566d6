"""Shared record types and fixed values."""

from pyspark.sql import types as T

DEFAULT_CATEGORY = "Uncategorized"
AMOUNT = T.DecimalType(18, 2)

# Internal transaction record; one row of any ledger.
TXN = T.StructType(
    [
        T.StructField("txn_date", T.DateType()),
        T.StructField("description", T.StringType()),
        T.StructField("amount", AMOUNT),
        T.StructField("category", T.StringType()),
        T.StructField("remarks", T.StringType()),
        T.StructField("account", T.StringType()),
    ]
)
TXN_COLUMNS = TXN.fieldNames()

# Order every list-order-dependent rule falls back to.
CANONICAL_ORDER = ["txn_date", "account", "amount", "description", "category", "remarks"]

# Storage header (fixed values of the file format).
LEDGER_COLUMNS = ["Date", "Description", "Debit", "Credit", "Category", "Remarks", "Account"]
CASH_COLUMNS = ["Date", "Description", "Debit", "Credit", "Category", "Remarks"]

LEDGER_STORAGE = T.StructType([T.StructField(c, T.StringType()) for c in LEDGER_COLUMNS])
CASH_STORAGE = T.StructType([T.StructField(c, T.StringType()) for c in CASH_COLUMNS])

PARSING_CONFIG = T.StructType(
    [
        T.StructField("config_key", T.StringType()),
        T.StructField("header_patterns", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("column_map", T.MapType(T.StringType(), T.StringType())),
        T.StructField("date_formats", T.ArrayType(T.StringType())),
        T.StructField("amount_sign_col", T.StringType()),
        T.StructField("debit_value", T.StringType()),
        T.StructField("special_handling", T.StringType()),
        T.StructField("statement_period_patterns", T.ArrayType(T.StringType())),
    ]
)

EXTRACTED = T.StructType(
    [
        T.StructField("statement_id", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("row_no", T.LongType()),
        T.StructField("date", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("debit", T.StringType()),
        T.StructField("credit", T.StringType()),
    ]
)

REVIEW = T.StructType(
    [
        T.StructField(c, T.StringType())
        for c in ("account", "date", "description", "debit", "credit", "reasons", "file")
    ]
)

CASH_MESSAGE = T.StructType(
    [
        T.StructField("update_id", T.LongType()),
        T.StructField("sent_at", T.TimestampType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("chat_id", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)
