"""Stored tables: ledgers, cash ledger, review surface, caches."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.amounts import parse_amount
from ledgerloom.functions.dates import bind, iso_date
from ledgerloom.functions.text import is_blank, text_or_empty
from ledgerloom.schema import AMOUNT, DEFAULT_CATEGORY, TXN


class VerificationFailed(RuntimeError):
    """A written table does not read back whole."""


def ledger_from_storage(stored: DataFrame, strict: bool = True) -> DataFrame:
    """S3: stored text columns to transactions.

    Column names match regardless of case; ``amount`` may stand in for debit / credit.
    Rows without any value or without an ISO date drop. An unreadable amount stops the
    read, so that no rewrite can lose the row; with ``strict`` off such rows are left out,
    and ``unreadable_amounts`` returns them.
    """
    names = {c.strip().lower(): c for c in stored.columns}

    def text(name: str):
        col = F.col(f"`{names[name]}`") if name in names else F.lit(None).cast("string")
        return F.when(~is_blank(col), col)

    paired = "debit" in names and "credit" in names
    if not paired and "amount" not in names:
        raise ValueError("a ledger needs debit and credit columns, or an amount column")
    read = F.struct(*[parse_amount(text(n)).alias(n) for n in ("debit", "credit", "amount") if n in names])
    unread = F.raise_error(F.lit("unreadable amount in the stored ledger")).cast(AMOUNT) if strict else F.lit(None).cast(AMOUNT)

    def signed(p: Column) -> Column:
        # A blank reads as 0, so only what cannot be read is NULL; every number is read once.
        whole = (p["credit"] - p["debit"]).cast(AMOUNT) if paired else p["amount"]
        return F.when(reduce(or_, [p[n].isNull() for n in ("debit", "credit", "amount") if n in names]), unread).otherwise(whole)

    amount = bind(read, signed)
    return (
        stored.select(
            iso_date(F.btrim(text("date"), F.lit("' "))).alias("txn_date"),
            text_or_empty(text("description")).alias("description"),
            amount.alias("amount"),
            F.coalesce(text("category"), F.lit(DEFAULT_CATEGORY)).alias("category"),
            text_or_empty(text("remarks")).alias("remarks"),
            F.coalesce(text("account"), F.lit("Unknown")).alias("account"),
        )
        .filter(F.col("txn_date").isNotNull() & F.col("amount").isNotNull())
    )


def unreadable(stored: DataFrame) -> Column:
    """Whether a printed amount of a stored row cannot be read."""
    names = {c.strip().lower(): c for c in stored.columns}
    present = [
        ~is_blank(F.col(f"`{names[n]}`")) & parse_amount(F.col(f"`{names[n]}`")).isNull()
        for n in ("debit", "credit", "amount") if n in names
    ]
    bad = F.lit(False)
    for p in present:
        bad = bad | p
    return bad


def unreadable_amounts(stored: DataFrame) -> DataFrame:
    """Stored rows whose printed amount cannot be read."""
    return stored.filter(unreadable(stored))


def read_ledger_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3 for a CSV ledger with a header row."""
    return ledger_from_storage(spark.read.option("multiLine", True).option("escape", '"').csv(path, header=True))


def cash_history(stored: DataFrame) -> DataFrame:
    """Labelled cash rows as category history; unreadable amounts count 0."""
    zero = F.lit(0).cast(AMOUNT)

    def number(c: str):
        s = F.regexp_replace(F.trim(text_or_empty(c)), ",", "")
        return F.coalesce(F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s).try_cast(AMOUNT), zero)

    return stored.filter(~is_blank("Category") & ~is_blank("Description")).select(
        iso_date("Date").alias("txn_date"),
        F.col("Description").alias("description"),
        (number("Credit") - number("Debit")).cast(AMOUNT).alias("amount"),
        F.col("Category").alias("category"),
        text_or_empty("Remarks").alias("remarks"),
        F.lit("cash").alias("account"),
    )


class TableStore:
    """Named Parquet tables with safe overwrite below one root folder.

    Each table is a chain of generations. An overwrite writes the next generation,
    verifies it, publishes it with a marker file and only then removes the older ones, so
    a failed write never leaves a table short. Paths go through the Hadoop file system.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    # -- file system -----------------------------------------------------------
    def _path(self, name: str, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, name, *parts]))

    def _fs(self):
        conf = self.spark._jsc.hadoopConfiguration()
        return self._path("").getFileSystem(conf)

    def _generations(self, name: str) -> list[int]:
        fs, folder = self._fs(), self._path(name)
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removeprefix("published-")) for n in names if n.startswith("published-"))

    def location(self, name: str) -> str | None:
        """Folder of the published generation, None before the first write."""
        gens = self._generations(name)
        return f"{self.root}/{name}/gen-{gens[-1]}" if gens else None

    # -- reading ---------------------------------------------------------------
    def read(self, name: str, schema: T.StructType) -> DataFrame:
        """S7 and friends: the table, or an empty frame of its schema."""
        where = self.location(name)
        if where is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(where)

    # -- writing ---------------------------------------------------------------
    def _write(self, df: DataFrame, where: str, mode: str, partition_by: list[str]) -> None:
        if partition_by:
            # Sizes files per partition value and splits large ones.
            df = df.hint("rebalance", *partition_by)
        df.write.mode(mode).partitionBy(*partition_by).parquet(where)

    def _publish(self, name: str, gen: int) -> None:
        fs = self._fs()
        fs.create(self._path(name, f"published-{gen}"), True).close()
        for old in self._generations(name)[:-1]:
            fs.delete(self._path(name, f"published-{old}"), False)
            fs.delete(self._path(name, f"gen-{old}"), True)

    def append(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> None:
        """Adds rows to the published generation."""
        where = self.location(name)
        if where is None:
            self.replace(name, df, partition_by)
        else:
            self._write(df, where, "append", partition_by or [])

    def replace(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> int:
        """Whole-table overwrite; returns the verified row count."""
        gen = (self._generations(name) or [0])[-1] + 1
        where = f"{self.root}/{name}/gen-{gen}"
        written = self._observed_write(df, where, partition_by or [])
        self.verify(where, written)
        self._publish(name, gen)
        return written

    def rewrite(self, name: str, df: DataFrame) -> DataFrame:
        """Writes a derived table over its last version and reads it back.

        What can be derived again is not counted and read back for proof.
        """
        gen = self.generation(name) + 1
        self._write(df, f"{self.root}/{name}/gen-{gen}", "overwrite", [])
        self._publish(name, gen)
        return self.read(name, df.schema)

    def publish_json(self, name: str, df: DataFrame) -> None:
        """A whole JSON table over its last version."""
        gen = self.generation(name) + 1
        df.write.mode("overwrite").json(f"{self.root}/{name}/gen-{gen}")
        self._publish(name, gen)

    def put_partitions(self, name: str, df: DataFrame, partition_by: list[str]) -> None:
        """Writes whole partitions: those in ``df`` are replaced, the others keep their files."""
        where = self.location(name)
        if where is None:
            self.replace(name, df, partition_by)
        else:
            df = df.hint("rebalance", *partition_by)
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(where)

    def partition_bytes(self, name: str, column: str) -> dict[str, int]:
        """Bytes of each partition of the first partition column."""
        where, fs = self.location(name), self._fs()
        if where is None:
            return {}
        found = fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(where))
        names = {s.getPath().getName(): s.getPath() for s in found}
        prefix = f"{column}="
        return {n.removeprefix(prefix): fs.getContentSummary(p).getLength() for n, p in names.items() if n.startswith(prefix)}

    def generation(self, name: str) -> int:
        """Number of the published generation, 0 before the first write."""
        return (self._generations(name) or [0])[-1]

    def _observed_write(self, df: DataFrame, where: str, partition_by: list[str]) -> int:
        from pyspark.sql import Observation

        if df.isEmpty():  # an empty plan is optimised away together with its observation
            self._write(df, where, "overwrite", partition_by)
            return 0
        seen = Observation(f"rows-{uuid.uuid4().hex}")
        self._write(df.observe(seen, F.count(F.lit(1)).alias("n")), where, "overwrite", partition_by)
        return int(seen.get["n"])

    def verify(self, where: str, expected: int) -> None:
        """The written folder must read back with exactly the rows written."""
        found = self.spark.read.parquet(where).count() if expected else expected
        if found != expected:
            raise VerificationFailed(f"{where}: wrote {expected} rows, read back {found}")

    def truncate(self, name: str, schema: T.StructType, first_row: bool = True) -> None:
        """Empties a table, keeping its schema; starting at a later row is a no-op."""
        if first_row:
            self.replace(name, self.spark.createDataFrame([], schema))


def month_of(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.date_format("txn_date", "yyyy-MM"))


LEDGER_TABLE = T.StructType([*TXN.fields, T.StructField("month", T.StringType())])


class LedgerStore(TableStore):
    """Bank and card ledgers partitioned by month, plus the side tables."""

    def read_ledger(self, kind: str, months: list[str] | None = None) -> DataFrame:
        """S3; with ``months`` only their partitions are read."""
        rows = self.read(f"ledger-{kind}", LEDGER_TABLE)
        if months is not None:
            rows = rows.filter(F.col("month").isin(months))
        return rows.drop("month")

    def read_all(self) -> DataFrame:
        """S4"""
        return self.read_ledger("bank").unionByName(self.read_ledger("cc"))

    def append_ledger(self, kind: str, df: DataFrame) -> None:
        """L5"""
        self.append(f"ledger-{kind}", month_of(df.select(*TXN.fieldNames())), ["month"])

    def overwrite_ledger(self, kind: str, df: DataFrame) -> int:
        """Empty input leaves the ledger as it is."""
        if df.isEmpty():
            return 0
        return self.replace(f"ledger-{kind}", month_of(df.select(*TXN.fieldNames())), ["month"])

    def rewrite_months(self, kind: str, df: DataFrame) -> int:
        """L6 by months: those in ``df`` are replaced and verified, the others keep their files.

        ``df`` must be a table of its own, not a plan over the months it replaces.
        """
        name, rows = f"ledger-{kind}", month_of(df.select(*TXN.fieldNames()))
        counts = {r.month: r.n for r in rows.groupBy("month").agg(F.count("*").alias("n")).collect()}
        if not counts:
            return 0
        self.put_partitions(name, rows, ["month"])
        read = self.read(name, LEDGER_TABLE).filter(F.col("month").isin(list(counts)))
        found = {r.month: r.n for r in read.groupBy("month").agg(F.count("*").alias("n")).collect()}
        if found != counts:
            raise VerificationFailed(f"{name}: wrote {counts}, read back {found}")
        return sum(counts.values())

    def truncate_ledger(self, kind: str, first_row: bool = True) -> None:
        """L12"""
        self.truncate(f"ledger-{kind}", LEDGER_TABLE, first_row)


def verify_rows(stored: DataFrame, expected: int) -> None:
    """L7 for a text ledger: non-blank rows, an optional leading header not counted."""
    cells = F.array(*[F.col(f"`{c}`").cast("string") for c in stored.columns])
    filled = stored.filter(F.exists(cells, lambda c: ~is_blank(c)))
    header = F.lower(F.trim(text_or_empty(F.col(f"`{stored.columns[0]}`")))) == "date"
    row = filled.agg(F.count("*").alias("n"), F.coalesce(F.max(header.cast("int")), F.lit(0)).alias("h")).first()
    if row.n - row.h != expected:
        raise VerificationFailed(f"wrote {expected} rows, read back {row.n - row.h}")
