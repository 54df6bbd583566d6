"""Statement catalogue: which files to read, for which account and period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of statement naming.
MID_MONTH = 15
BACKDATE_DAYS = 20


def files_of_type(files: DataFrame) -> DataFrame:
    """One row per (file, kind) whose name contains the kind."""
    name = F.lower("file_name")
    kinds = F.filter(F.array(F.lit("bank"), F.lit("cc")), lambda k: name.contains(k))
    return files.withColumn("kind", F.explode(kinds))


def resolve_account(files: DataFrame, accounts: DataFrame) -> DataFrame:
    """The longest account name contained in the file name; files without one drop.

    Instead of testing every file against every account, each file lists its substrings
    of the lengths account names have (a bounded set), and those meet the accounts in an
    equality join. ``accounts(kind, account, idx)``: ``idx`` breaks length ties.
    Names of many files are cut once.
    """
    lengths = accounts.agg(F.collect_set(F.length("account")).alias("_lengths"))
    named_files = files.withColumn("_name", F.lower("file_name"))
    name = F.col("_name")

    def cuts(n: Column) -> Column:
        starts = F.when(n <= F.length(name), F.sequence(F.lit(1), F.length(name) - n + 1))
        return F.coalesce(F.transform(starts, lambda i: F.substr(name, i, n)), F.array().cast("array<string>"))

    # One row of lengths beside every name; a scalar subquery cannot stand inside a lambda.
    candidates = named_files.select("_name", "kind").distinct().crossJoin(lengths).select(
        "_name", "kind", F.explode(F.array_distinct(F.flatten(F.transform("_lengths", cuts)))).alias("_cut")
    )
    named = accounts.select("kind", F.lower("account").alias("_cut"), "account", "idx")
    found = (
        candidates.join(named, ["kind", "_cut"])
        .groupBy("_name", "kind")
        .agg(F.max_by("account", F.struct(F.length("account"), -F.col("idx"))).alias("account"))
    )
    others = [c for c in files.columns if c not in ("file_id", "kind")]
    return named_files.join(found, ["_name", "kind"]).select("file_id", "kind", *others, "account")


def statement_period_end(files: DataFrame) -> DataFrame:
    """Last day of the period a file name ends with; NULL when it names none."""
    base = F.regexp_replace(F.split(F.lower("file_name"), r"\.")[0], r"_copy\d+$", "")
    parts = F.split(base, "-")
    last = F.trim(F.element_at(parts, -1))
    before = F.when(F.size(parts) >= 2, F.trim(F.element_at(parts, -2)))
    monthly = before.rlike(r"^\d{4}$") & last.rlike(r"^\d{2}$")
    month_start = F.try_to_timestamp(F.concat_ws("-", before, last, F.lit("01")), F.lit("yyyy-MM-dd"))
    year_end = F.try_to_timestamp(F.concat(last, F.lit("-12-31")), F.lit("yyyy-MM-dd"))
    return files.withColumn(
        "period_end",
        F.when(monthly, F.last_day(month_start.cast("date"))).when(
            before.isNotNull() & (F.col("kind") == "bank") & last.rlike(r"^\d{4}$"), year_end.cast("date")
        ),
    )


def dedup_statements(files: DataFrame) -> DataFrame:
    """C4: first file (by name, id) per account and period; unknown periods all stay."""
    own = F.when(F.col("period_end").isNull(), F.col("file_id").cast("string"))
    first = Window.partitionBy("account", "period_end", own).orderBy("file_name", "file_id")
    return files.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def skip_covered(files: DataFrame, watermark: DataFrame) -> DataFrame:
    """Drops files whose period the account's latest ledger date already covers.

    ``watermark(account, latest)``; both dates must be known to drop.
    """
    covered = (F.col("latest") >= F.col("period_end")).isNotNull() & (F.col("latest") >= F.col("period_end"))
    return files.join(watermark, "account", "left").filter(~covered).drop("latest")


def skip_processed(files: DataFrame, processed: DataFrame, watermark: DataFrame) -> DataFrame:
    """Drops files read before whose newest row the watermark still covers."""
    known = processed.select("file_id", "max_txn_date")
    seen = F.coalesce(F.col("latest") >= F.col("max_txn_date"), F.lit(False))
    return (
        files.join(known, "file_id", "left")
        .join(watermark, "account", "left")
        .filter(~seen)
        .drop("max_txn_date", "latest")
    )


def config_key(df: DataFrame) -> DataFrame:
    bank = F.get(F.split("account", "-"), F.lit(1))
    return df.withColumn("config_key", F.concat("kind", F.lit("-"), bank))


def route_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """Files with the key of their parsing configuration; others drop."""
    return config_key(files).join(configs.select("config_key").distinct(), "config_key", "left_semi")


def unrouted(files: DataFrame, configs: DataFrame) -> DataFrame:
    """C7 diagnostics: files no configuration exists for."""
    return config_key(files).join(configs.select("config_key").distinct(), "config_key", "left_anti")


def update_processed(
    rows: DataFrame, flagged: DataFrame, processed: DataFrame, immutable: Column | None = None
) -> DataFrame:
    """Newest row date of every cleanly read immutable file, over the old table."""
    clean = rows.join(flagged.select("file_id").distinct(), "file_id", "left_anti")
    if immutable is not None:
        clean = clean.filter(immutable)
    fresh = clean.groupBy("file_id").agg(F.max("txn_date").alias("max_txn_date"))
    return (
        processed.select("file_id", "max_txn_date", F.lit(0).alias("_gen"))
        .unionByName(fresh.withColumn("_gen", F.lit(1)))
        .groupBy("file_id")
        .agg(F.max_by("max_txn_date", "_gen").alias("max_txn_date"))
    )


def select_statement_mails(mails: DataFrame, configs: Sequence[dict], since: str) -> DataFrame:
    """Mails a fetch configuration asks for, one row per (mail, configuration).

    The configuration list compiles into predicates over the mail row: no join.
    """

    def wanted(i: int, cfg: dict) -> Column:
        cond = F.lower("subject").contains(cfg["subject"].lower())
        for field, column in (("from", "sender"), ("to", "recipient")):
            if cfg.get(field):
                cond = cond & F.lower(column).contains(cfg[field].lower())
        return F.when(cond, F.struct(F.lit(i).alias("config_idx"), F.lit(cfg["prefix"]).alias("prefix")))

    hits = F.array_compact(F.array(*[wanted(i, c) for i, c in enumerate(configs)]))
    return (
        mails.filter(
            F.col("has_attachment")
            & ~F.col("in_trash")
            & ~F.col("processed")
            & (F.col("received_at") > F.lit(since).cast("date"))
        )
        .withColumn("_hit", F.explode(hits))
        .select("*", "_hit.config_idx", "_hit.prefix")
        .drop("_hit")
    )


def infer_statement_name(mails: DataFrame) -> DataFrame:
    """Statement month from the arrival date, and the file name it gives."""
    day = F.col("received_at").cast("date")
    month = F.when(F.dayofmonth(day) < MID_MONTH, F.date_sub(day, BACKDATE_DAYS)).otherwise(day)
    return mails.withColumn(
        "base_name", F.concat("prefix", F.lit("-"), F.date_format(month, "yyyy-MM"), F.lit(".pdf"))
    )


def sliced_rank(df: DataFrame, keys: list[str], slice_column: str, order: list[str]) -> DataFrame:
    """``row_number`` per key without a task that holds a whole key.

    ``slice_column`` must not decrease along ``order``. Rows are ranked inside
    (key, slice) and shifted by the counts of the key's earlier slices.
    """
    part = [*keys, slice_column]
    ranked = df.withColumn("_local", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
    before = Window.partitionBy(*keys).orderBy(slice_column).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*part)
        .agg(F.count("*").alias("_n"))
        .select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        ranked.join(offsets, part)
        .withColumn("rank", F.col("_local") + F.col("_offset"))
        .drop("_local", "_offset")
    )


def assign_copy_names(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """C11: first free of ``name``, ``name_copy1``, ... in arrival order.

    With the taken numbers of a name sorted as e0 < e1 < ..., the numbers free below
    ``ej`` are ``ej - j``. The k-th newcomer therefore takes number k plus the count of
    taken numbers with ``ej - j <= k``; taken numbers merge into runs of equal
    ``ej - j``, and newcomers find their run by range, so no list per name is built.
    """
    # A mail two configurations want is two newcomers.
    own = [c for c in ("mail_id", "config_idx") if c in candidates.columns]
    candidates = candidates.withColumn("_id", F.struct(*own))
    stem = F.regexp_replace("base_name", r"\.[^.]*$", "")
    extension = F.regexp_extract("base_name", r"(\.[^.]*)$", 1)
    taken = (
        existing.select(
            F.regexp_replace("file_name", r"_copy[1-9]\d*(\.[^.]*)$", "$1").alias("base_name"),
            F.coalesce(
                F.nullif(F.regexp_extract("file_name", r"_copy([1-9]\d*)\.[^.]*$", 1), F.lit("")).try_cast("bigint"),
                F.lit(0),
            ).alias("number"),
        )
        .join(candidates.select("base_name").distinct(), "base_name", "left_semi")
        .distinct()
    )
    ranked = sliced_rank(candidates, ["base_name"], "received_at", ["received_at", "_id"]).withColumn(
        "k", F.col("rank") - 1
    )
    ordered = taken.withColumn("_slice", F.floor(F.col("number") / 100_000))
    runs = sliced_rank(ordered, ["base_name"], "_slice", ["number"]).withColumn("gap", F.col("number") - F.col("rank") + 1)
    marks = runs.select(
        "base_name", F.col("gap").alias("at"), F.lit(1).alias("is_taken"), F.lit(None).cast(candidates.schema["_id"].dataType).alias("_id")
    ).unionByName(
        ranked.select("base_name", F.col("k").alias("at"), F.lit(0).alias("is_taken"), "_id")
    ).withColumn("_slice", F.floor(F.col("at") / 100_000))
    inside = Window.partitionBy("base_name", "_slice").orderBy("at", F.desc("is_taken"), "_id").rowsBetween(
        Window.unboundedPreceding, 0
    )
    earlier = Window.partitionBy("base_name").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.groupBy("base_name", "_slice").agg(F.sum("is_taken").alias("_n")).select(
        "base_name", "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    numbered = (
        marks.withColumn("_taken", F.sum("is_taken").over(inside))
        .filter("is_taken = 0")
        .join(carried, ["base_name", "_slice"])
        .select("base_name", "_id", (F.col("at") + F.col("_taken") + F.col("_offset")).alias("number"))
    )
    return candidates.join(numbered, ["base_name", "_id"]).drop("_id").withColumn(
        "file_name",
        F.when(F.col("number") == 0, F.col("base_name")).otherwise(
            F.concat(stem, F.lit("_copy"), F.col("number").cast("string"), extension)
        ),
    )
