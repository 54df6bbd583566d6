"""Input views over the driver's tables.

Each view is one SQL text both engines run; operators are then applied in each engine on
its own. ``{name}`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import rounded

AS_OF = "2001-12-31"
HISTORY_END = "2000-01-01"
PAYROLL_SHARES = {
    "Total Salary": "1.0", "Total Tax": "0.2", "Equity": "0.1", "Small Savings": "0.0", "GSU Value": "0.2", "Credited GSU Value": "0.15", "Taxed GSU Value": "0.05",
}

_ACCOUNT = "(CASE WHEN l_linestatus = 'O' THEN 'bank-' ELSE 'cc-' END) || lower(replace(p_brand, '#', ''))"
_AMOUNT = "CAST(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE -l_extendedprice END AS DECIMAL(18,2))"
_PRICE = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING)"
_SLASHED = "lpad(CAST(day({0}) AS STRING), 2, '0') || '/' || lpad(CAST(month({0}) AS STRING), 2, '0') || '/' || CAST(year({0}) AS STRING)"
_PARTS = "FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"

VIEWS: dict[str, str] = {
    "ledger": f"""
        SELECT CAST(l_shipdate AS DATE) AS txn_date, {_ACCOUNT} AS account,
               upper(p_name) || ' ' || p_type || ' ' || CAST(l_orderkey AS STRING) AS description,
               {_AMOUNT} AS amount,
               CASE WHEN l_suppkey % 5 = 0 THEN 'Uncategorized'
                    WHEN l_suppkey % 5 IN (1, 2) THEN 'Expense:' || p_type
                    ELSE 'Bills:' || p_name END AS category,
               '' AS remarks
        {_PARTS}""",
    "incoming": f"""
        SELECT CAST(l_shipdate AS DATE) AS txn_date, {_ACCOUNT} AS account,
               CASE l_partkey % 3
                    WHEN 0 THEN lower(p_name) || '  ' || p_type || ' ' || CAST(l_orderkey AS STRING) || ' Value Dt 01/01/2000 Ref 77'
                    WHEN 1 THEN upper(p_name) || ' ' || p_type || ' ' || CAST(l_orderkey AS STRING) || ' PAYOUT'
                    ELSE 'UPI-' || p_name || '-' || lpad(CAST(l_orderkey AS STRING), 12, '6') || '-' || p_type END AS description,
               {_AMOUNT} AS amount
        {_PARTS}""",
    "stmt_cells": f"""
        SELECT l_orderkey AS statement_id, l_linenumber AS row_no,
               CASE l_partkey % 3
                    WHEN 0 THEN lpad(CAST(day(l_shipdate) AS STRING), 2, '0') || '-' || lpad(CAST(month(l_shipdate) AS STRING), 2, '0') || '-' || CAST(year(l_shipdate) AS STRING)
                    WHEN 1 THEN CAST(day(l_shipdate) AS STRING) || '/' || CAST(month(l_shipdate) AS STRING) || '/' || CAST(year(l_shipdate) AS STRING) || ' | 08:34'
                    ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS date_text,
               p_name || ' ' || CAST(l_orderkey AS STRING) AS description,
               CASE l_suppkey % 4
                    WHEN 0 THEN '₹' || {_PRICE}
                    WHEN 1 THEN '(' || {_PRICE} || ')'
                    WHEN 2 THEN {_PRICE} || ' Dr'
                    ELSE {_PRICE} || ' Cr' END AS amount_text,
               CASE l_returnflag WHEN 'R' THEN ' Debit ' WHEN 'A' THEN 'Credit' ELSE '' END AS indicator,
               CASE WHEN l_suppkey % 2 = 0 THEN 'Debit' ELSE '' END AS debit_value,
               CAST(l_shipdate AS DATE) AS true_date,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS price
        {_PARTS}""",
    "stmt_lines": f"""
        SELECT l_orderkey AS statement_id,
               CAST(CAST(l_shipdate AS DATE) AS STRING) || ' ' || p_name || ' ' || {_PRICE} AS line
        {_PARTS}""",
    "extracted": f"""
        SELECT l_orderkey AS statement_id, l_partkey, l_suppkey, p_name AS description,
               CAST(CAST(CASE WHEN l_suppkey % 7 = 0 THEN CAST(l_shipdate AS DATE) + INTERVAL '40' DAY ELSE l_shipdate END AS DATE) AS STRING) AS date,
               CASE WHEN l_returnflag <> 'R' THEN CAST(CAST(CASE WHEN l_partkey % 11 = 0 THEN l_extendedprice * 10 ELSE l_extendedprice END AS DECIMAL(18,2)) AS STRING) ELSE '' END AS debit,
               CASE WHEN l_returnflag = 'R' THEN {_PRICE} ELSE '' END AS credit
        {_PARTS}""",
    # Statements of two banks with formats and period lines of their own; some have no text.
    "bank_texts": f"""
        SELECT l_orderkey AS statement_id, l_orderkey % 2 AS bank,
               CASE WHEN l_orderkey % 11 = 0 THEN ' ' WHEN l_orderkey % 5 = 0 THEN 'No period here' WHEN l_orderkey % 2 = 0
                    THEN 'Statement Period 01/01/1990 - ' || {_SLASHED.format('MIN(l_shipdate)')} || ' end'
                    ELSE 'from 01 until ' || CAST(CAST(MIN(l_shipdate) AS DATE) AS STRING) END AS head,
               CASE WHEN l_orderkey % 3 = 0 THEN CAST(NULL AS DATE) ELSE CAST(MAX(l_shipdate) AS DATE) END AS period_end
        FROM {{lineitem}} GROUP BY l_orderkey""",
    "bank_rows": f"""
        SELECT l_orderkey AS statement_id, l_partkey, l_suppkey,
               CASE WHEN l_suppkey % 9 = 0 THEN 'someday' WHEN l_orderkey % 2 = 0 THEN {_SLASHED.format('l_shipdate')} ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS date,
               CAST(l_shipdate AS DATE) AS day
        FROM {{lineitem}}""",
    "files": """
        SELECT o_orderkey AS file_id,
               CASE WHEN o_orderkey % 10 = 9 THEN 'notes-' || CAST(o_orderkey AS STRING) || '.csv'
                    WHEN o_orderkey % 10 = 8 THEN 'bank-brand' || CAST(1 + o_custkey % 25 AS STRING) || '-' || CAST(year(o_orderdate) AS STRING) || '.csv'
                    ELSE (CASE WHEN o_orderstatus = 'O' THEN 'bank-' ELSE 'cc-' END) || 'brand' || CAST(1 + o_custkey % 25 AS STRING) || '-' || CAST(year(o_orderdate) AS STRING) || '-' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0')
                         || CASE WHEN o_orderkey % 10 = 7 THEN '_copy1' ELSE '' END || '.csv' END AS file_name
        FROM {orders}""",
    "processed": """
        SELECT o_orderkey AS file_id, CAST(o_orderdate AS DATE) AS max_txn_date
        FROM {orders} WHERE o_orderkey % 3 = 0""",
    "mails": """
        SELECT o_orderkey AS mail_id, CAST(o_orderdate AS DATE) AS received_at,
               CASE o_orderkey % 4 WHEN 0 THEN 'Your Bank Statement for ' || o_orderpriority
                                   WHEN 1 THEN 'Credit Card E-statement'
                                   WHEN 2 THEN 'your bank statement'
                                   ELSE 'Newsletter' END AS subject,
               CASE WHEN o_custkey % 3 = 0 THEN 'statements@bank.example' ELSE 'cards@bank.example' END AS sender,
               'user' || CAST(o_custkey % 5 AS STRING) || '@mail.example' AS recipient,
               o_orderkey % 7 <> 0 AS has_attachment,
               o_orderkey % 11 = 0 AS in_trash,
               o_orderkey % 13 = 0 AS processed
        FROM {orders}""",
    "stored_names": """
        SELECT DISTINCT
               (CASE WHEN o_custkey % 2 = 0 THEN 'bank-a-' ELSE 'cc-b-' END) || CAST(year(o_orderdate) AS STRING) || '-' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0')
               || CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE '_copy' || CAST(2 * (o_orderkey % 6) AS STRING) END || '.pdf' AS file_name
        FROM {orders}""",
    # One grid per order: preamble, header, data rows; every fifth is packed with '~',
    # every tenth has an unknown header. Data rows start at row 100.
    "stmt_grid": f"""
        SELECT file_id, row_no,
               CASE WHEN file_id % 5 = 0 THEN c0 || '~' || c1 || '~' || c2 || '~' || c3 || extra ELSE c0 END AS c0,
               CASE WHEN file_id % 5 = 0 THEN '' ELSE c1 END AS c1,
               CASE WHEN file_id % 5 = 0 THEN '' ELSE c2 END AS c2,
               CASE WHEN file_id % 5 = 0 THEN '' ELSE c3 END AS c3
        FROM (
          SELECT o_orderkey AS file_id, CAST(0 AS BIGINT) AS row_no, 'Statement of account' AS c0, '' AS c1, '' AS c2, '' AS c3, '' AS extra
          FROM {{orders}} WHERE o_orderkey % 3 >= 1
          UNION ALL
          SELECT o_orderkey, CAST(1 AS BIGINT), '', '', '', '', '' FROM {{orders}} WHERE o_orderkey % 3 = 2
          UNION ALL
          SELECT o_orderkey, CAST(o_orderkey % 3 AS BIGINT),
                 CASE WHEN o_orderkey % 10 = 9 THEN 'Datum' ELSE 'Tran Date' END,
                 CASE WHEN o_orderkey % 10 = 9 THEN 'Text' ELSE 'PARTICULARS' END,
                 CASE WHEN o_orderkey % 10 = 9 THEN 'Wert' ELSE ' Amount (INR) ' END,
                 CASE WHEN o_orderkey % 10 = 9 THEN 'Art' WHEN o_orderkey % 4 = 0 THEN 'Kind' ELSE 'Debit/Credit' END, ''
          FROM {{orders}}
          UNION ALL
          SELECT l_orderkey, CAST(100 + l_linenumber AS BIGINT),
                 CASE WHEN l_partkey % 13 = 0 THEN '' ELSE CAST(day(l_shipdate) AS STRING) || '/' || CAST(month(l_shipdate) AS STRING) || '/' || CAST(year(l_shipdate) AS STRING) END,
                 CASE WHEN l_partkey % 13 = 0 THEN '' ELSE p_name END,
                 CASE WHEN l_partkey % 13 = 0 THEN '' WHEN l_partkey % 17 = 0 THEN 'n/a' ELSE {_PRICE} END,
                 CASE WHEN l_partkey % 13 = 0 THEN '' WHEN l_returnflag = 'R' THEN 'Debit' ELSE 'Credit' END,
                 CASE WHEN l_linenumber = 7 THEN '~x' ELSE '' END
          FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
        ) g""",
    "grid_files": """
        SELECT o_orderkey AS file_id, 'bank-brand' || CAST(1 + o_custkey % 25 AS STRING) AS account,
               CASE WHEN o_orderkey % 5 = 0 THEN 'bank-packed' ELSE 'bank-plain' END AS config_key
        FROM {orders}""",
    "summaries": f"""
        SELECT l_orderkey AS statement_id,
               CASE WHEN l_orderkey % 7 = 3 THEN '' ELSE CAST(SUM(CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) + CASE WHEN l_orderkey % 5 = 0 THEN 5000 ELSE 0 END AS STRING) END AS total_debit,
               CASE WHEN l_orderkey % 7 = 4 THEN '' ELSE CAST(SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS STRING) END AS total_credit,
               CASE WHEN l_orderkey % 3 = 0 THEN '1,000.00' ELSE '' END AS opening_balance,
               CASE WHEN l_orderkey % 3 = 0 THEN CAST(1000 + SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE -CAST(l_extendedprice AS DECIMAL(18,2)) END) AS STRING) ELSE '' END AS closing_balance
        {_PARTS}
        GROUP BY l_orderkey""",
    "cash_msgs": """
        SELECT event_id AS update_id, ts AS sent_at, user_id, CAST(-100 AS BIGINT) AS chat_id,
               CASE event_type WHEN 'purchase' THEN 'Coffee ' || CAST(CAST(value AS DECIMAL(18,2)) AS STRING)
                               WHEN 'signup' THEN '+' || CAST(CAST(value AS DECIMAL(18,2)) AS STRING) || ' ATM'
                               WHEN 'error' THEN '/undo'
                               WHEN 'view' THEN 'see you tonight'
                               ELSE 'received ' || CAST(CAST(value AS DECIMAL(18,2)) AS STRING) || ' 2024-01-05' END AS text
        FROM {events}""",
    # Formatted yearly totals per account, one row per (tenant, year header, label).
    "year_cells": f"""
        SELECT account AS tenant_id, header, label,
               (CASE WHEN total < 0 THEN '-' ELSE '' END) || '₹' || CAST(abs(total) AS STRING) AS cell
        FROM (SELECT {_ACCOUNT} AS account, CAST(year(l_shipdate) AS STRING) AS header,
                     CASE l_returnflag WHEN 'R' THEN 'Income' WHEN 'A' THEN 'Regular Expenses' ELSE 'New Investments' END AS label,
                     SUM({_AMOUNT}) AS total
              {_PARTS} GROUP BY 1, 2, 3) y
        UNION ALL
        SELECT DISTINCT {_ACCOUNT}, 'Total', 'Income', '#N/A' {_PARTS}""",
    "holding_cells": """
        SELECT CAST(c_custkey AS STRING) AS tenant_id,
               CASE WHEN c_custkey % 9 = 0 THEN '#REF!' ELSE '₹' || CAST(CAST(abs(c_acctbal) * 1000 AS DECIMAL(18,2)) AS STRING) END AS invested,
               CASE WHEN c_acctbal < 0 THEN '−' ELSE '' END || '₹' || CAST(CAST(abs(c_acctbal) * 1310 AS DECIMAL(18,2)) AS STRING) AS value,
               CASE WHEN c_custkey % 8 = 0 THEN '' ELSE CAST(CAST(c_acctbal / 100 AS DECIMAL(18,2)) AS STRING) || '%' END AS xirr,
               CAST(c_custkey % 60 AS STRING) || '.5%' AS profit_pct
        FROM {customer}""",
    "fetch_log": """
        SELECT CAST(o_custkey AS STRING) AS tenant_id, CAST(o_orderdate AS DATE) AS attempt_date,
               CAST(o_orderkey % 3 AS BIGINT) AS new_count
        FROM {orders}""",
    "payslips": """
        SELECT CAST(o_custkey AS STRING) AS tenant_id,
               CAST(year(o_orderdate) AS STRING) || '-' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS period,
               CASE WHEN MIN(o_orderkey) % 3 = 0 THEN CAST(CAST(MAX(o_orderdate) AS DATE) AS STRING)
                    WHEN MIN(o_orderkey) % 3 = 1 THEN CAST(day(MAX(o_orderdate)) AS STRING) || '/' || CAST(month(MAX(o_orderdate)) AS STRING) || '/' || CAST(year(MAX(o_orderdate)) AS STRING)
                    ELSE 'soon' END AS date_of_payment,
               '₹' || CAST(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) * 0.7 + CASE WHEN MIN(o_orderkey) % 5 = 0 THEN 5000 ELSE 0 END AS DECIMAL(18,2)) AS STRING) AS net_pay,
               CAST(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) * 0.5 AS DECIMAL(18,2)) AS STRING) AS basic,
               CASE WHEN MIN(o_orderkey) % 4 = 0 THEN 'n/a' ELSE '-' || CAST(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) * 0.1 AS DECIMAL(18,2)) AS STRING) END AS hra,
               CAST(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) * 0.2 AS DECIMAL(18,2)) AS STRING) AS gsus_income,
               CAST(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) * 0.05 AS DECIMAL(18,2)) AS STRING) AS gsus_broker_tax
        FROM {orders} GROUP BY o_custkey, year(o_orderdate), month(o_orderdate)""",
    # Payroll grid in wide form, one column per month.
    "payroll_grid": """
        SELECT CAST(o_custkey AS STRING) AS tenant_id, year(o_orderdate) AS year, label, """
    + ", ".join(
        f"CAST(SUM(CASE WHEN month(o_orderdate) = {m} THEN CAST(o_totalprice AS DECIMAL(18,2)) * share END) AS DECIMAL(18,2)) AS m{m:02d}"
        for m in range(1, 13)
    )
    + """
        FROM {orders} CROSS JOIN (
            SELECT 'Total Salary' AS label, CAST(1.0 AS DECIMAL(4,2)) AS share UNION ALL SELECT 'Total Tax', 0.2 UNION ALL SELECT 'Equity', 0.1
            UNION ALL SELECT 'Small Savings', 0.0 UNION ALL SELECT 'GSU Value', 0.2
            UNION ALL SELECT 'Credited GSU Value', 0.15 UNION ALL SELECT 'Taxed GSU Value', 0.05) s
        GROUP BY o_custkey, year(o_orderdate), label""",
}

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


class Inputs:
    """The views as DataFrames over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        raise AttributeError(name)

    @property
    def payroll_grid(self) -> DataFrame:
        """The view of this name; each label is a share of one sum, so orders are summed before the labels."""
        price, month = F.col("o_totalprice").cast("decimal(18,2)"), F.month("o_orderdate")
        months = [f"m{m:02d}" for m in range(1, 13)]
        sums = [F.sum(F.when(month == m, price)).alias(c) for m, c in enumerate(months, 1)]
        totals = self.table("orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(*sums)
        shares = F.array(*[F.struct(F.lit(x).alias("label"), F.lit(s).cast("decimal(4,2)").alias("share")) for x, s in PAYROLL_SHARES.items()])
        wide = totals.withColumn("s", F.explode(shares))
        return wide.select(
            F.col("o_custkey").cast("string").alias("tenant_id"), "year", F.col("s.label").alias("label"),
            *[(F.col(c) * F.col("s.share")).cast("decimal(18,2)").alias(c) for c in months],
        )

    @property
    def holding_cells(self) -> DataFrame:
        """The view of this name with its doubles made decimals as DuckDB makes them, by their own value."""
        shown, balance, key = (lambda c: rounded(c, 2, "decimal(18,2)").cast("string")), F.col("c_acctbal"), F.col("c_custkey")
        rupees = lambda factor: F.concat(F.lit("₹"), shown(F.abs(balance) * factor))
        return self.table("customer").select(
            key.cast("string").alias("tenant_id"),
            F.when(key % 9 == 0, "#REF!").otherwise(rupees(1000)).alias("invested"),
            F.concat(F.when(balance < 0, "−").otherwise(""), rupees(1310)).alias("value"),
            F.when(key % 8 == 0, "").otherwise(F.concat(shown(balance / 100), F.lit("%"))).alias("xirr"),
            F.concat((key % 60).cast("string"), F.lit(".5%")).alias("profit_pct"),
        )

    @property
    def history(self) -> DataFrame:
        return self.ledger.filter(F.col("txn_date") < F.lit(HISTORY_END).cast("date"))

    @property
    def accounts(self) -> DataFrame:
        return self.ledger.select("account").distinct().select(
            F.substring_index("account", "-", 1).alias("kind"), "account", F.lit(0).alias("idx")
        )

    @property
    def stmt_text(self) -> DataFrame:
        return self.stmt_lines.groupBy("statement_id").agg(
            F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text")
        )

    @property
    def grid(self) -> DataFrame:
        return self.stmt_grid.select("file_id", "row_no", F.array("c0", "c1", "c2", "c3").alias("cells"))


def cte(*names: str) -> str:
    """``WITH`` clause that defines views for the oracle."""
    body = []
    for n in names:
        text = VIEWS[n]
        for t in TABLES:
            text = text.replace("{" + t + "}", t)
        body.append(f"{n} AS ({text})")
    return "WITH " + ",\n".join(body)
