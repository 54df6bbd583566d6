"""Freshness of fetches and ledgers (H1-H3); one verdict per tenant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import iso_date

STALE_DAYS = 45


def fetch_status(log: DataFrame) -> DataFrame:
    """H1: ``log(tenant_id, attempt_date, new_count)`` to its last attempt and last success."""
    found = F.col("new_count") > 0
    return log.groupBy("tenant_id").agg(
        F.max("attempt_date").alias("last_attempt"),
        F.max(F.when(found, F.col("attempt_date"))).alias("last_new_date"),
        F.max_by("new_count", F.when(found, F.struct("attempt_date", "new_count"))).alias("last_new_count"),
    )


def days_since(c: Column | str, as_of: str) -> Column:
    """H2: whole days from an ISO date text; NULL when unreadable."""
    col = F.col(c) if isinstance(c, str) else c
    then = iso_date(F.substring(col.cast("string"), 1, 10))
    return F.datediff(F.lit(as_of).cast("date"), then)


def evaluate_health(latest: DataFrame, status: DataFrame, as_of: str) -> DataFrame:
    """H3: verdict and message per tenant.

    ``latest(tenant_id, latest, pipeline_error, new_count)``: one row per tenant of this
    run; ``status`` comes from ``fetch_status``.
    """
    j = latest.join(status.select("tenant_id", "last_new_date"), "tenant_id", "left")
    fetch_age = days_since("last_new_date", as_of)
    txn_age = days_since("latest", as_of)
    problems = F.array_compact(
        F.array(
            F.when(
                F.coalesce("pipeline_error", F.lit("")) != "",
                F.concat(F.lit("pipeline error: "), "pipeline_error"),
            ),
            F.when(fetch_age.isNull() & (F.col("new_count") == 0), "no statement PDF ever fetched").when(
                fetch_age > STALE_DAYS, F.concat(F.lit("no new statement in "), fetch_age.cast("string"), F.lit("d"))
            ),
            F.when(F.col("latest").isNull(), "no transactions in log").when(
                txn_age > STALE_DAYS, F.concat(F.lit("latest txn "), txn_age.cast("string"), F.lit("d old"))
            ),
        )
    )
    ok = F.concat(
        F.lit("OK | +"), F.col("new_count").cast("string"), F.lit(" pdfs | latest txn "),
        F.date_format("latest", "yyyy-MM-dd"),
    )
    return j.select(
        "tenant_id",
        (F.size(problems) == 0).alias("is_up"),
        F.when(F.size(problems) == 0, ok).otherwise(F.array_join(problems, "; ")).alias("message"),
    )
