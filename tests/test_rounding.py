"""Doubles as printed amounts."""

from pyspark.sql import functions as F

from ledgerloom.checks.views import Inputs
from ledgerloom.functions.amounts import format_inr, rounded


def test_halves_round_by_the_doubles_own_value(spark):
    rows = spark.createDataFrame([(3810500.0,), (7835000.0,), (-7835000.0,), (12500.0,), (38105000.0,), (None,)], "v double")
    shown = [r.s for r in rows.select(format_inr(F.col("v").cast("decimal(28,2)")).alias("s")).collect()]
    assert shown == ["₹38.10 L", "₹78.35 L", "₹-78.35 L", "₹12,500", "₹3.81 Cr", "—"]
    doubles = spark.createDataFrame([(81.365,), (78.835,), (0.125,), (-0.125,), (None,)], "v double")
    assert [r.d if r.d is None else str(r.d) for r in doubles.select(rounded("v").alias("d")).collect()] == ["81.36", "78.83", "0.13", "-0.13", None]


def test_shares_of_customers_round_by_the_doubles_own_value(spark, tmp_path):
    rows = [(12731, 8136.5), (852, 7883.5), (5, 12.5)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    found = {r.tenant_id: r.xirr for r in Inputs(spark, str(tmp_path)).holding_cells.collect()}
    assert found == {"12731": "81.36%", "852": "78.83%", "5": "0.13%"}
