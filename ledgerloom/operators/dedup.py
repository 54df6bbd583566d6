"""Duplicate elimination and row filters over transactions."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import alnum, desc_signature, is_blank, signature_key
from ledgerloom.schema import CANONICAL_ORDER, DEFAULT_CATEGORY

KEY_COLUMNS = ["txn_date", "account", "amount", "signature"]


def order_columns(df: DataFrame) -> list[str]:
    return [c for c in CANONICAL_ORDER if c in df.columns]


def description_signatures(df: DataFrame) -> DataFrame:
    """Rows with the parts of their description signature."""
    return df.withColumn("sig", desc_signature("description")).select(
        "*", "sig.kind", "sig.refs", "sig.txt", "sig.gst"
    ).drop("sig")


def txn_key(df: DataFrame) -> DataFrame:
    """Adds the noise-tolerant part of the duplicate key."""
    return df.withColumn("signature", signature_key("description"))


def keyless(df: DataFrame) -> DataFrame:
    """Incoming rows no key can be built for; they are rejected, one by one."""
    return df.filter(F.col("txn_date").isNull() | F.col("account").isNull() | F.col("amount").isNull())


def find_new(
    old: DataFrame, incoming: DataFrame, dedup_on_cold_start: bool = False, accounts: DataFrame | None = None
) -> DataFrame:
    """Incoming rows the ledger does not hold, first occurrence per key.

    Per ledger type (account prefix) an empty ledger switches deduplication off,
    unless ``dedup_on_cold_start``. Copies are dropped map-side first (the rank
    limit is pushed below the shuffle), then both sides meet on the full key, so no
    single account, date or repeated row can fill one task.

    ``old`` may be the part of the ledger with the batch's days and accounts; ``accounts``
    then lists all accounts of the ledgers, which tells the empty ones.
    """
    keyed = txn_key(incoming).filter(
        F.col("txn_date").isNotNull() & F.col("account").isNotNull() & F.col("amount").isNotNull()
    )
    first = Window.partitionBy(*KEY_COLUMNS).orderBy(*order_columns(incoming))
    old_keys = txn_key(old).select(*KEY_COLUMNS).distinct()

    def deduplicated(rows: DataFrame) -> DataFrame:
        return (
            rows.withColumn("_rank", F.row_number().over(first))
            .filter("_rank = 1")
            .drop("_rank")
            .join(old_keys, KEY_COLUMNS, "left_anti")
        )

    if dedup_on_cold_start:
        return deduplicated(keyed).drop("signature")
    kinds = (old if accounts is None else accounts).select(ledger_kind("account").alias("kind")).agg(F.collect_set("kind")).scalar()
    known = F.array_contains(kinds, ledger_kind("account"))
    warm = deduplicated(keyed.filter(known))
    cold = keyed.filter(~known)
    return warm.select(*cold.columns).unionByName(cold).drop("signature")


def drop_ignored(df: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """Rows no ignore rule matches; rules without text never match.

    The rules are one constant array of (reduced text, account), whatever their number,
    and every row is held against it in place: no join, no second plan.
    """
    wanted = [(re.sub("[^a-z0-9]", "", str(r.get("description_contains", "")).lower()), r.get("account")) for r in rules]
    wanted = [(w, a or None) for w, a in wanted if w]
    if not wanted:
        return df
    listed = F.from_json(F.lit(json.dumps([{"text": w, "account": a} for w, a in wanted])), "array<struct<text:string,account:string>>")
    desc, account = alnum("description"), F.coalesce(F.col("account"), F.lit(""))
    hit = F.exists(listed, lambda r: desc.contains(r["text"]) & (r["account"].isNull() | (r["account"] == account)))
    return df.filter(~hit)


def is_unlabelled(c: Column | str = "category") -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return is_blank(col) | (F.coalesce(col, F.lit("")) == DEFAULT_CATEGORY)


def uncategorised(df: DataFrame) -> DataFrame:
    """D6"""
    return df.filter(is_unlabelled())


def labelled(df: DataFrame) -> DataFrame:
    """D7"""
    return df.filter(~is_unlabelled())


def ledger_kind(account: Column | str) -> Column:
    name = F.lower(F.trim(F.coalesce(F.col(account) if isinstance(account, str) else account, F.lit(""))))
    return F.when(name.startswith("bank"), "bank").when(name.startswith("cc"), "cc").otherwise("unknown")


def route(df: DataFrame) -> DataFrame:
    """Adds the ledger each row belongs to."""
    return df.withColumn("ledger", ledger_kind("account"))
