"""Checks of extracted statement rows against statement text and printed totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import money_text, printed_number
from ledgerloom.functions.dates import DATE_TOKEN, bind, parse_timestamp
from ledgerloom.functions.text import as_col, norm_text, text_or_empty

# Fixed values of the checks.
END_GRACE_DAYS = 5
ABSOLUTE_TOLERANCE = "2.0"
RELATIVE_TOLERANCE = "0.0025"
MIN_TOKEN_SHARE = 0.5
TOKEN_LENGTH = 4
MIN_ROWS_FOR_COUNT = 5
COUNT_FACTOR = 3
DATED_LINES = [r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", r"\b\d{1,2} [a-z]{3} \d{2,4}\b"]
NO_TEXT = "no_text_layer"
NO_TEXT_FLAG = "no_text_layer: cannot validate; sent to review"
ISO_PATTERN = "yyyy-M-d"


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))


def with_settings(statements: DataFrame, formats: Sequence[str] = (), patterns: Sequence[str] = ()) -> DataFrame:
    """Statements with ``date_formats`` and ``period_patterns`` of their own.

    Both are row data, so statements of many banks are checked in one plan; the lists given
    here stand in where a statement has no such column or no value in it.
    """
    for name, default in (("date_formats", formats), ("period_patterns", patterns)):
        given = F.array(*[F.lit(x) for x in default]).cast("array<string>")
        statements = statements.withColumn(name, F.coalesce(name, given) if name in statements.columns else given)
    return statements


def normalised_texts(statements: DataFrame) -> DataFrame:
    """V1 / V2: normalised text per statement; blank where there is none."""
    return statements.withColumn("norm_text", norm_text("text"))


def no_text(text: Column | str = "norm_text") -> Column:
    """V2: nothing to hold the rows against."""
    return F.coalesce(as_col(text), F.lit("")) == ""


def _end_group(pattern: Column) -> Column:
    """Number of the group a period pattern names ``end``; NULL without one."""
    before = F.regexp_replace(F.regexp_extract(pattern, r"(?s)^(.*?)\(\?P<end>", 1), r"(?s)\\.|\[[^\]]*\]", "")
    groups = F.regexp_count(before, F.lit(r"\((?!\?)|\(\?P<")) + 1
    return F.when(pattern.contains("(?P<end>"), groups.cast("int"))


def period_end_in_text(text: Column, patterns: Column, formats: Column) -> Column:
    """End date of the first period pattern that matches and parses.

    Patterns name their end date ``(?P<end>...)``; names become group numbers.
    """

    def read(p: Column) -> Column:
        plain = F.replace(p, F.lit("?P<"), F.lit("?<"))
        found = F.nullif(F.call_function("regexp_extract", text, plain, F.coalesce(_end_group(p), F.lit(0))), F.lit(""))
        return F.when(_end_group(p).isNotNull(), parse_timestamp(found, formats))

    return F.get(F.filter(F.transform(patterns, read), lambda t: t.isNotNull()), F.lit(0))


def statement_end(statements: DataFrame, as_of: str) -> DataFrame:
    """V3: latest date a row may carry: printed end, else file end, else today, plus grace."""
    today = F.lit(as_of).cast("timestamp_ntz")
    printed = period_end_in_text(F.col("norm_text"), F.col("period_patterns"), F.col("date_formats"))
    end = F.coalesce(printed, F.col("period_end").cast("timestamp_ntz"))
    grace = F.expr(f"INTERVAL {END_GRACE_DAYS} DAYS")
    dated = statements.withColumn("_end", end)
    return dated.withColumn(
        "last_date", F.when(F.col("_end").isNull(), today).otherwise(F.least(F.col("_end") + grace, today))
    ).drop("_end")


def date_reasons(formats: Column | str = "date_formats") -> Column:
    """V4: reasons against the date, as an array with NULLs for passed checks."""
    raw = F.trim(text_or_empty("date"))
    accepted = F.array_union(as_col(formats), F.array(F.lit(ISO_PATTERN)))
    d = norm_text(raw)
    token = F.regexp_extract(d, DATE_TOKEN, 0)
    present = (F.instr(F.col("norm_text"), d) > 0) | (
        (token != "") & (token != d) & (F.instr(F.col("norm_text"), token) > 0)
    )

    def reasons(ts: Column) -> Column:
        return F.array(
            F.when(ts.isNull(), F.concat(F.lit("date_unparseable:"), _quoted(raw))),
            F.when(ts.isNotNull() & ~present, F.concat(F.lit("date_not_in_source:"), _quoted(raw))),
            F.when(
                ts > F.col("last_date"),
                F.concat(
                    F.lit("date_after_end:"), F.date_format(ts, "yyyy-MM-dd"), F.lit(">"),
                    F.date_format("last_date", "yyyy-MM-dd"),
                ),
            ),
        )

    return bind(F.when(raw != "", parse_timestamp(raw, accepted)), reasons)


def runs_in(text: Column | str) -> Column:
    """V5: every number a text prints, each once.

    Commas are dropped. A run is a whole stretch of digits, or two stretches with one dot
    between them; a minus sign before the first one gives a signed run as well.
    """
    plain = F.regexp_replace(norm_text(text), ",", "")
    chains = F.regexp_extract_all(plain, F.lit(r"(?<!\d)-?\d+(?:\.\d+)*"), F.lit(0))

    def runs(chain: Column) -> Column:
        parts = F.split(F.ltrim(chain, F.lit("-")), r"\.")
        pairs = F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda i: F.when(i < F.size(parts), F.concat(F.get(parts, i - 1), F.lit("."), F.get(parts, i))),
        )
        signed = F.transform(F.array(F.get(parts, F.lit(0)), F.get(pairs, F.lit(0))), lambda r: F.concat(F.lit("-"), r))
        return F.concat(parts, pairs, F.when(chain.startswith("-"), signed).otherwise(F.array().cast("array<string>")))

    return F.array_distinct(F.flatten(F.transform(chains, runs)))


def proved_runs(asked: DataFrame, statements: DataFrame) -> DataFrame:
    """V5: the (statement_id, run) of ``asked`` that the statement's text prints, each once.

    Asked runs meet the text as one set a statement, so the many printed numbers nobody
    asks for are never rows of their own.
    """
    wanted = asked.groupBy("statement_id").agg(F.collect_set("run").alias("_wanted"))
    met = wanted.join(statements.select("statement_id", "text"), "statement_id")
    found = F.array_intersect("_wanted", runs_in("text"))
    return met.select("statement_id", F.explode(found).alias("run")).distinct()


def amount_run(c: str) -> Column:
    """The run that proves an amount: its digits if it is whole, else its two-place form.

    A whole amount is bounded by digits only, so 20 is found in 20.50 (and in 20.00).
    """
    number = printed_number(c)
    return F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(money_text(number))


def with_amount_reasons(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """V5: adds ``amount_reasons``, an array with NULLs for passed checks.

    The numbers of each text are listed once; each side of a row meets the proved ones in an
    equality join on (statement, run), so no pattern runs per row and a long statement spreads.
    """
    both = F.array_compact(F.array(amount_run("debit"), amount_run("credit")))
    index, out = proved_runs(rows.select("statement_id", F.explode(both).alias("run")), statements), rows
    for side in ("debit", "credit"):
        found = index.select("statement_id", F.col("run").alias(f"_{side}_run"), F.lit(True).alias(f"_{side}_found"))
        out = out.withColumn(f"_{side}_run", amount_run(side)).join(found, ["statement_id", f"_{side}_run"], "left")

    def missing(side: str) -> Column:
        absent = F.col(f"_{side}_run").isNotNull() & F.col(f"_{side}_found").isNull()
        return F.when(absent, F.concat(F.lit(f"{side}_not_in_source:"), _quoted(F.col(side))))

    none = F.when(F.col("_debit_run").isNull() & F.col("_credit_run").isNull(), "no_amount")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], F.array(none, missing("debit"), missing("credit")).alias("amount_reasons"))


def description_overlap() -> Column:
    """V6: share of significant description tokens found in the text (1 without any)."""
    words = F.filter(
        F.regexp_extract_all(F.lower(text_or_empty("description")), F.lit("([a-z0-9]+)"), 1),
        lambda w: F.length(w) >= TOKEN_LENGTH,
    )
    hits = F.size(F.filter(words, lambda w: F.instr(F.col("norm_text"), w) > 0))
    return F.when(F.size(words) == 0, F.lit(1.0)).otherwise(hits / F.size(words))


def validate_rows(
    extracted: DataFrame, statements: DataFrame, as_of: str,
    formats: Sequence[str] = (), period_patterns: Sequence[str] = (),
) -> DataFrame:
    """V2-V7: extracted rows with ``reasons`` (empty = passed) and the soft description flag.

    ``statements(statement_id, text, period_end)``, and ``date_formats`` / ``period_patterns``
    where statements have settings of their own. The text is read at the join and not
    carried on, so a long statement is not copied into its rows.
    """
    own = with_settings(statements, formats, period_patterns)
    texts = statement_end(normalised_texts(own), as_of).select("statement_id", "norm_text", "last_date", "date_formats")
    rows = with_amount_reasons(extracted, statements).join(texts, "statement_id", "left")
    formats_known = F.coalesce("date_formats", F.array().cast("array<string>"))
    checks = F.array_compact(F.concat(date_reasons(formats_known), F.col("amount_reasons")))
    return rows.select(
        *extracted.columns,
        F.when(no_text(), F.array(F.lit(NO_TEXT))).otherwise(checks).alias("reasons"),
        (~no_text() & (description_overlap() < MIN_TOKEN_SHARE)).alias("low_confidence"),
    )


def passed(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("reasons") == 0)


def flagged(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("reasons") > 0)


def dated_lines(text: Column) -> Column:
    return F.regexp_count(text, F.lit(DATED_LINES[0])) + F.regexp_count(text, F.lit(DATED_LINES[1]))


def count_sanity(counts: DataFrame, statements: DataFrame) -> DataFrame:
    """V8: statements whose row count is far from the dates in their text.

    ``counts(statement_id, rows)``.
    """
    texts = statements.select("statement_id", dated_lines(norm_text("text")).cast("long").alias("dates"))
    n, d = F.col("rows"), F.col("dates")
    return counts.join(texts, "statement_id").withColumn(
        "count_mismatch",
        (n >= MIN_ROWS_FOR_COUNT) & (d > 0) & ~((d <= n * COUNT_FACTOR) & (n <= d * COUNT_FACTOR)),
    )


def _near(a: Column, b: Column) -> Column:
    slack = F.greatest(
        F.lit(ABSOLUTE_TOLERANCE).cast("decimal(38,8)"),
        (F.lit(RELATIVE_TOLERANCE).cast("decimal(8,4)") * F.abs(b)).cast("decimal(38,8)"),
    )
    return F.abs(a - b) <= slack


def statement_sums(extracted: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("decimal(28,6)")

    def side(c: str) -> Column:
        return F.coalesce(printed_number(c).cast("decimal(28,6)"), zero)

    return extracted.groupBy("statement_id").agg(
        F.sum(side("debit")).cast("decimal(28,2)").alias("sum_debit"),
        F.sum(side("credit")).cast("decimal(28,2)").alias("sum_credit"),
    )


def reconcile(extracted: DataFrame, summaries: DataFrame) -> DataFrame:
    """V9: statements whose sums differ from their printed totals, one row per side.

    Side totals count only with both present and, when balances exist, their net equal
    to the balance change; else the balance net is used, else any single side.
    """
    p = {c: printed_number(c).cast("decimal(28,2)").alias(c) for c in
         ("total_debit", "total_credit", "opening_balance", "closing_balance")}
    printed = summaries.select("statement_id", *p.values())
    j = printed.join(statement_sums(extracted), "statement_id", "left").fillna(0, ["sum_debit", "sum_credit"])
    td, tc = F.col("total_debit"), F.col("total_credit")
    sd, sc = F.col("sum_debit"), F.col("sum_credit")
    net = F.abs(F.col("closing_balance") - F.col("opening_balance"))
    both = td.isNotNull() & tc.isNotNull()
    sides = both & (net.isNull() | _near(F.abs(td - tc), net))
    balance = ~sides & net.isNotNull()
    single = ~sides & net.isNull()

    def finding(when: Column, side: str, ours: Column, theirs: Column, words: tuple[str, str]) -> Column:
        text = F.concat(F.lit(f"txns {words[0]} "), money_text(ours), F.lit(f" vs {words[1]} "), money_text(theirs))
        return F.when(
            F.coalesce(when & ~_near(ours, theirs), F.lit(False)),
            F.struct(F.lit(side).alias("side"), text.alias("message")),
        )

    total = ("sum", "statement")
    findings = F.array(
        finding(sides | (single & td.isNotNull()), "debit", sd, td, total),
        finding(sides | (single & tc.isNotNull()), "credit", sc, tc, total),
        finding(balance, "net", F.abs(sd - sc), net, ("net", "balances")),
    )
    return (
        j.select("statement_id", F.explode(F.array_compact(findings)).alias("f"))
        .select("statement_id", "f.side", "f.message")
    )


def best_attempt(validated: DataFrame) -> DataFrame:
    """Rows of the attempt with the fewest flagged rows, ties to the earlier one."""
    bad = F.sum(F.when(F.size("reasons") > 0, 1).otherwise(0)).over(Window.partitionBy("statement_id", "attempt"))
    best = F.min(F.struct("_bad", "attempt")).over(Window.partitionBy("statement_id"))
    ranked = validated.filter("statement_id IS NOT NULL").repartition("statement_id").withColumn("_bad", bad).withColumn("_best", best)
    return ranked.filter(F.col("attempt") == F.col("_best.attempt")).select(*[F.col(f"`{c}`") for c in validated.columns])


def statement_flags(
    validated: DataFrame, statements: DataFrame, summaries: DataFrame | None = None
) -> DataFrame:
    """Statement-level warnings (V2, V6, V8, V9): one row per flag."""
    counts = validated.groupBy("statement_id").agg(
        F.count("*").alias("rows"), F.sum(F.col("low_confidence").cast("int")).alias("low")
    )
    texts = statements.select("statement_id", norm_text("text").alias("t"))
    facts = counts.join(texts, "statement_id", "left")
    n, d = F.col("rows"), dated_lines(F.col("t"))
    has_text = F.coalesce(F.col("t"), F.lit("")) != ""
    off = (n >= MIN_ROWS_FOR_COUNT) & (d > 0) & ~((d <= n * COUNT_FACTOR) & (n <= d * COUNT_FACTOR))
    flags = F.array_compact(
        F.array(
            F.when(~has_text, NO_TEXT_FLAG),
            F.when(
                has_text & (F.col("low") > 0),
                F.concat(F.lit("low_confidence_descriptions: "), F.col("low"), F.lit("/"), n),
            ),
            F.when(
                has_text & off,
                F.concat(F.lit("count_mismatch: "), n, F.lit(" txns vs ~"), d, F.lit(" dated lines")),
            ),
        )
    )
    out = facts.select("statement_id", F.explode(flags).alias("flag"))
    if summaries is None:
        return out
    with_text = texts.filter(F.coalesce(F.col("t"), F.lit("")) != "").select("statement_id")
    sums = reconcile(validated, summaries).join(with_text, "statement_id", "left_semi")
    return out.unionByName(
        sums.select(
            "statement_id",
            F.concat(F.lit("reconcile_mismatch ("), "side", F.lit("): "), "message").alias("flag"),
        )
    )


def review_rows(validated: DataFrame, flags: DataFrame, files: DataFrame) -> DataFrame:
    """Review surface: flagged rows, and one row per statement flag.

    ``files(statement_id, account, file_name)``.
    """
    bad = flagged(validated).join(files, "statement_id", "left").select(
        "account", "date", "description", "debit", "credit",
        F.array_join("reasons", "; ").alias("reasons"), F.col("file_name").alias("file"),
    )
    empty = F.lit("")
    notes = flags.join(files, "statement_id", "left").select(
        "account", empty.alias("date"), F.lit("STATEMENT").alias("description"), empty.alias("debit"),
        empty.alias("credit"), F.col("flag").alias("reasons"), F.col("file_name").alias("file"),
    )
    return bad.unionByName(notes)
