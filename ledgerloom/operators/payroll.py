"""Payroll splits over many employees and months.

Tables carry ``tenant_id`` and ``period`` (``yyyy-MM``).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import text_or_empty
from ledgerloom.operators.summary import grid_to_long
from ledgerloom.schema import AMOUNT

MONTH = r"^\d{4}-(0[1-9]|1[0-2])$"
GUARD_SHARE = "0.001"
MIN_SPLIT = "0.5"
PAY_DATE_PATTERNS = ["yyyy-M-d", "d-MMM-yyyy", "d/M/yyyy"]
WIDE = "decimal(28,2)"


def coerce_payslip(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Printed payslip fields to positive numbers, 0 when unreadable."""

    def number(c: str) -> Column:
        s = F.trim(F.regexp_replace(text_or_empty(c), "[,₹]", ""))
        readable = s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
        return F.abs(F.coalesce(F.when(readable, s).try_cast(WIDE), F.lit(0).cast(WIDE))).alias(c)

    present = [c for c in fields if c in df.columns]
    return df.select(*[c for c in df.columns if c not in present], *[number(c) for c in present])


def checked_formula(formula: str, fields: Sequence[str]) -> Column:
    """A configured formula as a column: field names, numbers and ``+ - * / ( )`` only."""
    for word in re.findall(r"[A-Za-z_]\w*", formula):
        if word not in fields:
            raise ValueError(f"unknown payslip field {word!r} in {formula!r}")
    if not re.fullmatch(r"[\w\s.+\-*/()]+", formula):
        raise ValueError(f"unsupported formula {formula!r}")
    return F.expr(formula)


def payroll_inputs(df: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """One rounded value per (tenant, period, label)."""
    fields = [c for c in df.columns if c not in ("tenant_id", "period")]
    values = [
        F.struct(
            F.lit(label).alias("label"),
            F.bround(checked_formula(f, fields), 0).cast("bigint").alias("value"),
        )
        for label, f in formulas.items()
    ]
    return df.select("tenant_id", "period", F.explode(F.array(*values)).alias("v")).select(
        "tenant_id", "period", "v.label", "v.value"
    )


def unknown_labels(formulas: dict[str, str], grid: DataFrame) -> DataFrame:
    """Configured labels the grid lacks, per tenant."""
    want = F.explode(F.array(*[F.lit(x) for x in formulas]))
    tenants = grid.select("tenant_id").distinct().select("tenant_id", want.alias("label"))
    return tenants.join(grid.select("tenant_id", "label").distinct(), ["tenant_id", "label"], "left_anti")


def payroll_block(grid: DataFrame) -> DataFrame:
    """Long numeric cells of ``grid(tenant_id, year, label, m01..m12)``."""
    cells = grid_to_long(grid, ["tenant_id", "year", "label"], "month", "value")
    return (
        cells.filter(F.col("value").isNotNull() & (F.trim("label") != ""))
        .select(
            "tenant_id",
            F.concat_ws("-", F.lpad(F.col("year").cast("string"), 4, "0"), F.substring("month", 2, 2)).alias("period"),
            F.trim("label").alias("label"),
            F.col("value").cast(WIDE).alias("value"),
        )
    )


def _map_table(df: DataFrame, split_map: dict[str, dict]) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(label, s["category"], s["sign"]) for label, s in split_map.items()],
        "label string, category string, sign string",
    )


def split_payroll(block: DataFrame, split_map: dict[str, dict]) -> DataFrame:
    """Signed, categorised components; the map has one row per configured label."""
    signed = F.when(F.col("sign") == "credit", F.col("value")).otherwise(-F.col("value"))
    return (
        block.join(_map_table(block, split_map), "label")
        .filter(F.abs("value") >= F.lit(MIN_SPLIT).cast("decimal(3,1)"))
        .select("tenant_id", "period", "label", "category", signed.cast(AMOUNT).alias("amount"))
    )


def missing_labels(block: DataFrame, split_map: dict[str, dict]) -> DataFrame:
    """(tenant, period, label) the map needs and the block lacks; such periods fail."""
    want = F.explode(F.array(*[F.lit(x) for x in split_map]))
    periods = block.select("tenant_id", "period").distinct().select("tenant_id", "period", want.alias("label"))
    return periods.join(block.select("tenant_id", "period", "label"), ["tenant_id", "period", "label"], "left_anti")


def rounding_residual(block: DataFrame, gross: str, credited: str, taxed: str) -> DataFrame:
    """P5: gross - credited - taxed per period, a missing label counting 0."""
    weight = F.when(F.col("label") == gross, 1).when(F.col("label").isin(credited, taxed), -1).otherwise(0)
    return block.groupBy("tenant_id", "period").agg(F.sum(F.col("value") * weight).cast(WIDE).alias("residual"))


def net_pay_guard(
    splits: DataFrame, payslips: DataFrame, residuals: DataFrame | None = None
) -> DataFrame:
    """Per period the reconciled difference to net pay and whether it is accepted."""
    sums = splits.groupBy("tenant_id", "period").agg(F.sum("amount").cast(WIDE).alias("split_sum"))
    j = payslips.select("tenant_id", "period", F.col("net_pay").cast(WIDE).alias("net_pay")).join(
        sums, ["tenant_id", "period"], "left"
    )
    if residuals is None:
        j = j.withColumn("residual", F.lit(0).cast(WIDE))
    else:
        j = j.join(residuals, ["tenant_id", "period"], "left")
    zero = F.lit(0).cast(WIDE)
    diff = F.coalesce("split_sum", zero) - F.coalesce("residual", zero) - F.col("net_pay")
    slack = F.greatest(
        F.lit(1).cast("decimal(38,6)"),
        (F.abs("net_pay") * F.lit(GUARD_SHARE).cast("decimal(4,3)")).cast("decimal(38,6)"),
    )
    return j.select(
        "tenant_id", "period", diff.cast(WIDE).alias("difference"), (F.abs(diff) <= slack).alias("accepted")
    )


def synthetic_description(period: Column | str, employer: str = "Employer") -> Column:
    p = F.col(period) if isinstance(period, str) else period
    month = F.date_format(F.try_to_date(F.concat(p, F.lit("-01")), "yyyy-MM-dd"), "MMM-yy")
    return F.concat(F.lit(f"{employer} Salary "), month, F.lit(" (auto-split from payslip)"))


def unsplit_periods(payslips: DataFrame, ledger: DataFrame, employer: str = "Employer") -> DataFrame:
    """Payslip months whose split rows the ledger lacks.

    ``ledger`` needs tenant_id and description. Periods that name no month are left to
    ``bad_periods``.
    """
    done = ledger.select("tenant_id", F.trim("description").alias("_desc")).distinct()
    months = payslips.select("tenant_id", "period").filter(F.col("period").rlike(MONTH)).distinct()
    return (
        months.withColumn("_desc", synthetic_description("period", employer))
        .join(done, ["tenant_id", "_desc"], "left_anti")
        .drop("_desc")
    )


def bad_periods(payslips: DataFrame) -> DataFrame:
    """Payslips whose period is not a month."""
    return payslips.filter(~F.coalesce(F.col("period").rlike(MONTH), F.lit(False)))


def next_unsplit(payslips: DataFrame, ledger: DataFrame, employer: str = "Employer") -> DataFrame:
    """The newest month to split per tenant."""
    return unsplit_periods(payslips, ledger, employer).groupBy("tenant_id").agg(F.max("period").alias("period"))


def pay_date(c: Column | str, period: Column | str) -> Column:
    """Printed pay date, else the end of the period."""
    raw = F.trim(F.col(c) if isinstance(c, str) else c)
    p = F.col(period) if isinstance(period, str) else period
    month_end = F.last_day(F.try_to_timestamp(F.concat(p, F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date"))
    fits = [F.try_to_timestamp(raw, F.lit(f)).cast("date") for f in PAY_DATE_PATTERNS]
    return F.coalesce(*fits, month_end)


def ledger_rows(splits: DataFrame, payslips: DataFrame, account: str, employer: str = "Employer") -> DataFrame:
    """Accepted components as transactions."""
    dated = payslips.select("tenant_id", "period", pay_date("date_of_payment", "period").alias("txn_date"))
    return splits.join(dated, ["tenant_id", "period"]).select(
        "tenant_id",
        "txn_date",
        synthetic_description("period", employer).alias("description"),
        "amount",
        "category",
        F.lit("").alias("remarks"),
        F.lit(account).alias("account"),
    )
