"""Ledger aggregates, overwrite guard, backup and restore rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import text_or_empty
from ledgerloom.operators.categorize import categorize
from ledgerloom.operators.category_index import build_index
from ledgerloom.operators.dedup import is_unlabelled, labelled, ledger_kind
from ledgerloom.schema import CANONICAL_ORDER, TXN_COLUMNS

MIN_READ_RATIO = 0.9


class OverwriteRefused(RuntimeError):
    """A ledger rewrite would lose rows."""


def latest_by_account(df: DataFrame) -> DataFrame:
    """L1: the batch watermark."""
    return df.groupBy("account").agg(F.max("txn_date").alias("latest"))


def latest_overall(df: DataFrame) -> DataFrame:
    """L2"""
    return df.agg(F.max("txn_date").alias("latest"))


def backup_counts(backup: DataFrame) -> DataFrame:
    """L3: backed-up rows per ledger."""
    per_account = backup.groupBy("account").agg(F.count("*").alias("n"))
    return (
        per_account.groupBy(ledger_kind("account").alias("ledger"))
        .agg(F.sum("n").alias("rows"))
        .filter("ledger <> 'unknown'")
    )


def check_overwrite(df: DataFrame, backup: DataFrame | None, require_baseline: bool = True) -> DataFrame:
    """L4: one verdict row per ledger (plus unknown accounts), NULL verdict = safe."""
    have = df.groupBy(ledger_kind("account").alias("ledger")).agg(F.count("*").alias("have"))
    if backup is None:
        missing = "no baseline" if require_baseline else None
        kinds = df.sparkSession.createDataFrame([("bank",), ("cc",), ("unknown",)], "ledger string")
        base = kinds.withColumn("base", F.lit(0).cast("long")).withColumn("no_base", F.lit(missing).cast("string"))
    else:
        kinds = df.sparkSession.createDataFrame([("bank",), ("cc",), ("unknown",)], "ledger string")
        base = (
            kinds.join(backup_counts(backup), "ledger", "left")
            .select("ledger", F.coalesce("rows", F.lit(0)).alias("base"), F.lit(None).cast("string").alias("no_base"))
        )
    out = base.join(have, "ledger", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    verdict = (
        F.when((F.col("ledger") == "unknown") & (F.col("have") > 0), "unknown accounts")
        .when(F.col("no_base").isNotNull() & (F.col("ledger") != "unknown"), F.col("no_base"))
        .when((F.col("base") > 0) & (F.col("have") < F.col("base") * F.lit(MIN_READ_RATIO).cast("decimal(3,1)")), "truncated read")
    )
    return out.select("ledger", "have", "base", verdict.alias("verdict"))


def assert_safe(verdicts: DataFrame) -> None:
    """Raises on any refusing verdict (three rows at most)."""
    bad = verdicts.filter("verdict IS NOT NULL").collect()
    if bad:
        raise OverwriteRefused("; ".join(f"{r.ledger}: {r.verdict} ({r.have} of {r.base})" for r in bad))


def _own_id() -> Column:
    # A date's own text is the same as its format for years of four digits, and much cheaper.
    four_digits = F.col("txn_date").between(F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date"))
    day = F.when(four_digits, F.col("txn_date").cast("date").cast("string")).otherwise(F.date_format("txn_date", "yyyy-MM-dd"))
    parts = F.concat_ws(
        "-",
        day,
        text_or_empty("account"),
        F.coalesce(F.col("amount").cast("string"), F.lit("0.00")),
        text_or_empty("description"),
    )
    return F.sha2(parts, 256)


def backup_id(df: DataFrame) -> DataFrame:
    """Backup key: hash of date, account, amount and the raw description."""
    return df.withColumn("id", _own_id())


def backup_upsert(df: DataFrame, backup: DataFrame | None) -> DataFrame:
    """The backup after an upsert; per id the last written row stays.

    Rows are dealt by eight bytes of their id and carry the id itself only where it is
    not the one their own columns give, as digits of a hash are most of a row's bytes.
    """
    fresh = backup_id(df.select(*TXN_COLUMNS)).withColumn("_gen", F.lit(1))
    differs = ~F.col("id").eqNullSafe(_own_id())
    if backup is None or backup.select(*TXN_COLUMNS).dtypes == df.select(*TXN_COLUMNS).dtypes:
        # The union changes no column, so a fresh row's id is its own.
        differs = (F.col("_gen") == 0) & differs
    if backup is not None:
        fresh = backup.select(*fresh.columns[:-1], F.lit(0).alias("_gen")).unionByName(fresh)
    other = F.when(differs, F.struct("id")).alias("_other")
    dealt = fresh.select(*TXN_COLUMNS, "_gen", other, F.xxhash64("id").alias("_deal")).repartition("_deal")
    # Sorted before the ids are made again, so they are not sorted either. Rows of one deal nearly always
    # share their id; a row stays unless a later written one before it in the deal has its id.
    order = [F.desc("_gen"), *[F.desc(c) for c in CANONICAL_ORDER]]
    placed = dealt.sortWithinPartitions("_deal", *order)
    known = placed.withColumn("id", F.when(F.col("_other").isNull(), _own_id()).otherwise(F.col("_other.id")))
    named = known.withColumn("_key", F.struct("id"))
    later = F.collect_set("_key").over(Window.partitionBy("_deal").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return named.withColumn("_later", later).filter(~F.array_contains("_later", F.col("_key"))).select(*TXN_COLUMNS, "id")


def restore(backup: DataFrame) -> DataFrame:
    """Backed-up rows, routed by account prefix."""
    return backup.select(*TXN_COLUMNS).withColumn("ledger", ledger_kind("account"))


def recategorize(ledger: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """Layered categories for unlabelled rows; every other row as it is.

    The label is decided per row in the same plan, so no row identity is needed.
    """
    todo = ledger.filter(is_unlabelled())
    done = labelled(ledger)
    index = build_index(done, "global")
    fresh = categorize(todo, index, rules).select(*ledger.columns)
    return done.unionByName(fresh)
