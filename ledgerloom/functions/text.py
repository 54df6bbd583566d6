"""Description normalisation and signatures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: they decide which descriptions count as equal.
REFERENCE = r"(?<!\d)\d{12}(?!\d)"
GST_TAG = r"(?i)\b([csi]gst)\b"
METADATA_SUFFIX = r"(?i)\s+(?:value dt|ref)\b.*$"
MIN_TOKEN_LENGTH = 3


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(as_col(c), F.lit(""))


def is_blank(c: Column | str) -> Column:
    return F.trim(text_or_empty(c)) == ""


def norm(c: Column | str) -> Column:
    """Lower case, digit runs to ``#``, letters / ``#`` / ``/`` kept, spaces collapsed."""
    digits = F.regexp_replace(F.lower(text_or_empty(c)), r"\d+", "#")
    return F.trim(F.regexp_replace(digits, r"[^a-z#/]+", " "))


def tokens_of_norm(n: Column | str) -> Column:
    """Content tokens of an already normalised description."""
    return F.filter(F.split(as_col(n), "[/ ]"), lambda t: F.length(t) >= MIN_TOKEN_LENGTH)


def tokens(c: Column | str) -> Column:
    return tokens_of_norm(norm(c))


def is_debit(amount: Column | str) -> Column:
    """True for money out; an unknown amount counts as a credit."""
    return F.coalesce(as_col(amount) < 0, F.lit(False))


def alnum(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]", "")


def norm_text(c: Column | str) -> Column:
    """Statement text with whitespace collapsed, trimmed and lower-cased."""
    return F.lower(F.trim(F.regexp_replace(text_or_empty(c), r"\s+", " ")))


def desc_signature(c: Column | str) -> Column:
    """What makes two descriptions the same booking.

    With 12-digit payment references: their sorted distinct set and the GST tag.
    Otherwise: the text before trailing bank metadata, alphanumerics only.
    """
    desc = text_or_empty(c)
    refs = F.array_sort(F.array_distinct(F.regexp_extract_all(desc, F.lit(REFERENCE), 0)))
    by_ref = F.size(refs) > 0
    return F.struct(
        F.when(by_ref, "ref").otherwise("txt").alias("kind"),
        F.array_join(refs, ",").alias("refs"),
        F.when(by_ref, "").otherwise(alnum(F.regexp_replace(desc, METADATA_SUFFIX, ""))).alias("txt"),
        F.when(by_ref, F.lower(F.regexp_extract(desc, GST_TAG, 1))).otherwise("").alias("gst"),
    )


def signature_key(c: Column | str) -> Column:
    """``desc_signature`` as one string; the parts are free of the separator."""
    s = desc_signature(c)
    return F.concat_ws("|", s["kind"], s["refs"], s["txt"], s["gst"])
