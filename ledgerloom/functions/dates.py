"""Mixed date parsing as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import as_col

# Fixed value: the leading date of a cell that also carries a time or a separator.
DATE_TOKEN = (
    r"\d{4}-\d{1,2}-\d{1,2}"
    r"|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
    r"|\d{1,2}\s+[A-Za-z]{3,}\s+\d{2,4}"
)

# strptime directive -> datetime pattern letter(s).
DIRECTIVES = {
    "%d": "d",
    "%m": "M",
    "%Y": "yyyy",
    "%y": "yy",
    "%b": "MMM",
    "%B": "MMMM",
    "%H": "H",
    "%M": "m",
    "%S": "s",
}

# Tried when no configured format fits: ISO first, then day-first forms.
INFERENCE_PATTERNS = [
    "yyyy-M-d",
    "yyyy-M-d H:m:s",
    "yyyy-M-d'T'H:m:s",
    "yyyy/M/d",
    "yyyyMMdd",
    "d/M/yyyy",
    "d/M/yyyy H:m:s",
    "d/M/yyyy H:m",
    "d-M-yyyy",
    "d-M-yyyy H:m:s",
    "d.M.yyyy",
    "d/M/yy",
    "d-M-yy",
    "d MMM yyyy",
    "d-MMM-yyyy",
    "d MMMM yyyy",
    "d MMM yy",
    "d-MMM-yy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
]
PIVOT_YEAR = 2068


def datetime_pattern(fmt: str) -> str:
    """Translate a strptime format into a Spark datetime pattern."""

    def piece(m: re.Match[str]) -> str:
        if m.group(0).startswith("%"):
            return DIRECTIVES[m.group(0)]
        return f"'{m.group(0)}'"

    return re.sub(r"%[A-Za-z]|[A-Za-z]+", piece, fmt)


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value computed once, however often ``fn`` reads it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _attempt(text: Column, pattern: Column, two_digit_year: Column | bool) -> Column:
    ts = F.try_to_timestamp(text, pattern).cast("timestamp_ntz")
    if two_digit_year is False:
        return ts
    century_off = F.lit(True) if two_digit_year is True else two_digit_year
    return bind(
        ts, lambda t: F.when(century_off & (F.year(t) > PIVOT_YEAR), t - F.expr("INTERVAL 100 YEARS")).otherwise(t)
    )


def _may_fit(text: Column, pattern: Column) -> Column:
    """False only where the pattern cannot read the text: its first separator is not in it.

    A failed attempt costs an exception, many times the price of this look.
    """
    mark = F.regexp_extract(pattern, "[-/.,:]", 0)
    return (mark == "") | pattern.contains("[") | text.contains(mark)


def _first_fit(text: Column, patterns: Column | Sequence[str]) -> Column | None:
    if isinstance(patterns, Column):

        def read(p: Column) -> Column:
            return F.when(_may_fit(text, p), _attempt(text, p, p.contains("yy") & ~p.contains("yyyy")))

        # Patterns after the first fit are not tried.
        return F.aggregate(patterns, F.lit(None).cast("timestamp_ntz"), lambda found, p: F.coalesce(found, read(p)))
    if not patterns:
        return None
    return F.coalesce(*[_attempt(text, F.lit(p), "yy" in p and "yyyy" not in p) for p in patterns])


# How a pattern's letters look in the outline of a cell.
_OUTLINE = {"yyyy": "#", "MMM": "&", "MMMM": "@"}


def outline_of(pattern: str) -> str:
    """Outline of the cells a datetime pattern reads: ``#`` four digits, ``9`` one or two,
    ``&`` three letters, ``@`` more; everything else stands for itself."""

    def piece(m: re.Match[str]) -> str:
        part = m.group(0)
        return part[1:-1] if part.startswith("'") else _OUTLINE.get(part, "9")

    return re.sub(r"'[^']*'|([A-Za-z])\1*", piece, pattern.replace("yyyyMMdd", "yyyyyyyy").replace("yyyyyyyy", "'##'"))


def outline(text: Column) -> Column:
    digits = F.regexp_replace(F.regexp_replace(text, r"\d{4}", "#"), r"\d{1,2}", "9")
    return F.regexp_replace(F.regexp_replace(digits, "[A-Za-z]{4,}", "@"), "[A-Za-z]{3}", "&")


def _inferred(text: Column) -> Column:
    """The cell read by the inference pattern of its outline: one attempt a cell."""
    known = F.create_map(*[F.lit(x) for p in reversed(INFERENCE_PATTERNS) for x in (outline_of(p), p)])
    return bind(
        F.try_element_at(known, outline(text)),
        lambda p: _attempt(text, p, p.contains("yy") & ~p.contains("yyyy")),
    )


def parse_timestamp(
    c: Column | str, patterns: Column | Sequence[str] = (), infer: bool = True
) -> Column:
    """First fit of the configured patterns over the cell and its leading date token.

    ``patterns`` holds Spark datetime patterns, as a list or as an array column.
    All configured patterns are tried on both candidates before any inference.
    """
    def read(text: Column) -> Column:
        token = F.regexp_extract(text, DATE_TOKEN, 0)
        candidates = [text, F.when((token != "") & (token != text), token)]
        fits = [_first_fit(t, patterns) for t in candidates]
        if infer:
            fits += [_inferred(t) for t in candidates]
        return F.coalesce(*[f for f in fits if f is not None])

    return bind(F.regexp_replace(F.btrim(as_col(c), F.lit("' ")), r"\s+", " "), read)


def parse_date(c: Column | str, patterns: Column | Sequence[str] = (), infer: bool = True) -> Column:
    return parse_timestamp(c, patterns, infer).cast("date")


def iso_date(c: Column | str) -> Column:
    """Strict ``yyyy-MM-dd`` date, NULL when the text is anything else."""
    return F.try_to_timestamp(as_col(c), F.lit("yyyy-MM-dd")).cast("date")
