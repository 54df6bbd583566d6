"""Mirror of bank cash movements into the cash ledger (M1-M3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import alnum, text_or_empty
from ledgerloom.operators.dedup import order_columns

MARKER = r"auto:[^\s]+"


def mirror_marker(df: DataFrame) -> DataFrame:
    """M1: stable marker of a mirrored transaction."""
    return df.withColumn(
        "marker",
        F.concat_ws(
            ":",
            F.lit("auto"),
            text_or_empty("account"),
            F.date_format("txn_date", "yyyy-MM-dd"),
            F.coalesce(F.col("amount").cast("string"), F.lit("0.00")),
            F.substring(F.sha1(alnum("description")), 1, 8),
        ),
    )


def existing_markers(cash: DataFrame) -> DataFrame:
    """M2: every marker in the remarks of cash rows."""
    return cash.select(
        F.explode(F.regexp_extract_all(text_or_empty("Remarks"), F.lit(MARKER), 0)).alias("marker")
    ).distinct()


def mirror_cash(df: DataFrame, directions: dict[str, str], cash: DataFrame) -> DataFrame:
    """M3: cash rows for categories in ``directions`` not mirrored yet.

    The map is a configuration file and compiles into the plan; copies of one marker are
    dropped map-side before the anti join.
    """
    pairs = [x for item in directions.items() for x in map(F.lit, item)]
    direction = F.element_at(F.create_map(*pairs), F.col("category")) if pairs else F.lit(None).cast("string")
    first = Window.partitionBy("marker").orderBy(*order_columns(df))
    candidates = mirror_marker(df.filter(F.col("category").isin(list(directions)))).withColumn("direction", direction)
    size = F.abs(F.col("amount")).cast("string")
    return (
        candidates.withColumn("_rank", F.row_number().over(first))
        .filter("_rank = 1")
        .join(existing_markers(cash), "marker", "left_anti")
        .select(
            F.date_format("txn_date", "yyyy-MM-dd").alias("Date"),
            text_or_empty("description").alias("Description"),
            F.when(F.col("direction") == "in", "").otherwise(size).alias("Debit"),
            F.when(F.col("direction") == "in", size).otherwise("").alias("Credit"),
            F.col("category").alias("Category"),
            F.col("marker").alias("Remarks"),
        )
    )
