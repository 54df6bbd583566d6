"""Yearly and holdings summaries per tenant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import display_number, format_inr, format_pct

# Output field -> row label of the yearly grid (fixed values).
ANNUAL_ROWS = {
    "income": "Income",
    "regular_expenses": "Regular Expenses",
    "new_investments": "New Investments",
}


def grid_to_long(grid: DataFrame, keys: list[str], names: str, values: str) -> DataFrame:
    """Wide label grid to one row per cell."""
    cells = [c for c in grid.columns if c not in keys]
    return grid.unpivot(keys, cells, names, values)


def annual_figures(grid: DataFrame, as_of: str) -> DataFrame:
    """the current year's figures per tenant, or those of its latest year.

    ``grid(tenant_id, label, <year columns>)``: columns whose name is an integer are years.
    Of rows with one label the last by ``row_no`` counts, where the grid has that column;
    without it the largest.
    """
    years = sorted(int(c) for c in grid.columns if c.strip().isdigit())
    this_year = int(as_of[:4])
    year = this_year if this_year in years or not years else max(years)
    column = next((c for c in grid.columns if c.strip().isdigit() and int(c) == year), None)
    value = display_number(f"`{column}`") if column else F.lit(None).cast("decimal(38,6)")
    return grid.groupBy("tenant_id").agg(
        F.lit(year).alias("year"),
        *[
            _last(F.when(F.col("label") == label, value), F.col("label") == label, grid).cast("decimal(28,2)").alias(name)
            for name, label in ANNUAL_ROWS.items()
        ],
    )


def _last(value: Column, own: Column, rows: DataFrame) -> Column:
    return F.max_by(value, F.when(own, F.col("row_no"))) if "row_no" in rows.columns else F.max(value)


def annual_figures_long(cells: DataFrame, as_of: str) -> DataFrame:
    """F4 over long cells ``(tenant_id, header, label, cell)``: each tenant has its own years."""
    year = F.when(F.trim("header").rlike("^[0-9]+$"), F.trim("header")).try_cast("int")
    this_year = int(as_of[:4])
    long = cells.withColumn("year", year).filter("year IS NOT NULL")
    pick = long.groupBy("tenant_id").agg(
        F.coalesce(F.max(F.when(F.col("year") == this_year, F.col("year"))), F.max("year")).alias("year")
    )
    return (
        long.join(pick, ["tenant_id", "year"])
        .groupBy("tenant_id", "year")
        .agg(
            *[
                _last(F.when(F.col("label") == label, display_number("cell")), F.col("label") == label, cells)
                .cast("decimal(28,2)").alias(name)
                for name, label in ANNUAL_ROWS.items()
            ]
        )
    )


def holdings(grid: DataFrame) -> DataFrame:
    """``grid(tenant_id, invested, value, xirr, profit_pct)`` of formatted cells."""
    invested, value = (display_number(c).cast("decimal(28,2)") for c in ("invested", "value"))
    return grid.select(
        "tenant_id",
        value.alias("value"),
        invested.alias("invested"),
        (value - invested).cast("decimal(28,2)").alias("profit"),
        format_pct("xirr").alias("xirr"),
        format_pct("profit_pct").alias("profit_pct"),
    )


def summary_record(held: DataFrame, annual: DataFrame, updated: str) -> DataFrame:
    """the feed record of every tenant."""
    j = held.join(annual, "tenant_id", "full")
    return j.select(
        "tenant_id",
        format_inr("value").alias("net_worth"),
        F.col("value").alias("net_worth_raw"),
        format_inr("value").alias("portfolio_value"),
        format_inr("invested").alias("invested"),
        format_inr("profit").alias("profit"),
        F.coalesce("profit_pct", F.lit("—")).alias("profit_pct"),
        F.coalesce("xirr", F.lit("—")).alias("xirr"),
        "year",
        format_inr("income").alias("income"),
        F.col("income").alias("income_raw"),
        format_inr("regular_expenses").alias("regular_expenses"),
        format_inr("new_investments").alias("new_investments"),
        F.lit(updated).alias("updated"),
    )
