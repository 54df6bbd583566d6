"""Layered categorisation, rule matching, vocabulary and keyword mining."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import bind
from ledgerloom.functions.text import is_blank, is_debit, norm, text_or_empty
from ledgerloom.operators.category_index import (
    CategoryIndex,
    first_seen_key,
    key_answers,
)
from ledgerloom.operators.dedup import labelled
from ledgerloom.schema import DEFAULT_CATEGORY

# Fixed values shown to the reviewer.
REVIEW_REMARK = "REVIEW: auto-categorization uncertain"
LOW_CONFIDENCE_REMARK = "REVIEW: low-confidence auto-category"

EXAMPLES_PER_CATEGORY = 3
EXAMPLE_LENGTH = 60
KEYWORDS_PER_RULE = 10
KEYWORD_MIN_COUNT = 3
CASE_RULES = 200
GRAM = 4


def _facts() -> Column:
    """What rules read of a row: lower-cased texts and the sign."""
    return F.struct(
        F.lower(text_or_empty("description")).alias("desc"),
        is_debit("amount").alias("debit"),
        F.lower(text_or_empty("account")).alias("account"),
    )


def rule_condition(rule: dict, facts: Column | None = None) -> Column:
    facts = _facts() if facts is None else facts
    desc = facts["desc"]
    patterns = []
    for p in rule.get("description", []):
        hit = desc.contains(str(p).lower())
        if rule.get("use_regex"):
            hit = hit | desc.rlike(f"(?i){p}")
        patterns.append(hit)
    cond = F.lit(False)
    for p in patterns:
        cond = cond | p
    if isinstance(rule.get("debit"), bool):
        cond = (facts["debit"] == rule["debit"]) & cond
    if isinstance(rule.get("account"), str):
        cond = facts["account"].contains(rule["account"].lower()) & cond
    return cond


def rule_category(rules: Sequence[dict]) -> Column:
    """Category of the first matching rule, NULL when none matches.

    The rules read a row's lower-cased texts from one value. Written out per rule the CASE
    outgrows what the JVM compiles, and its stage runs interpreted.
    """

    def first(facts: Column) -> Column:
        column: Column | None = None
        for rule in rules:
            cond, category = rule_condition(rule, facts), rule.get("category", DEFAULT_CATEGORY)
            column = F.when(cond, category) if column is None else column.when(cond, category)
        return column

    return bind(_facts(), first) if rules else F.lit(None).cast("string")


def match_rules(df: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """Adds ``rule_category``, that of the first matching rule.

    Up to ``CASE_RULES`` rules are one short-circuiting CASE; longer lists go through an
    index of their texts, whose plan does not grow with the list. Both give the same rows.
    """
    if len(rules) <= CASE_RULES:
        return df.withColumn("rule_category", rule_category(rules))
    return match_rules_indexed(df, rules)


def _rule_texts(df: DataFrame, rules: Sequence[dict]) -> tuple[DataFrame, list[int]]:
    """One row per plain rule text with the gram that finds it, and the lengths of the grams.

    A text is found by the gram of it that fewest texts of the list hold.
    """
    texts = [(i, str(p).lower()) for i, r in enumerate(rules) for p in r.get("description", [])]
    grams = [{t[k : k + GRAM] for k in range(max(1, len(t) - GRAM + 1))} for _, t in texts]
    held = Counter(g for own in grams for g in own)
    rows = []
    for (i, text), own in zip(texts, grams, strict=True):
        debit, account = rules[i].get("debit"), rules[i].get("account")
        best = min(sorted(own), key=lambda g: held[g])
        rows.append((best, text, i, debit if isinstance(debit, bool) else None, account.lower() if isinstance(account, str) else None))
    table = df.sparkSession.createDataFrame(rows, "_gram string, _text string, _rule int, _debit boolean, _part string")
    return table, sorted({len(r[0]) for r in rows})


def match_rules_indexed(df: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """K13 for long rule lists: an inverted index from grams to rule texts, candidates verified.

    Distinct (description, sign, account) values are matched once. Regular expressions stay
    a CASE of their own over the rows; the lower rule number of both wins.
    """
    desc, account = F.lower(text_or_empty("description")), F.lower(text_or_empty("account"))
    table, lengths = _rule_texts(df, rules)
    keyed = df.withColumn("_d", desc).withColumn("_s", is_debit("amount")).withColumn("_a", account)
    keys = keyed.select("_d", "_s", "_a").distinct()

    def grams(n: int) -> Column:
        starts = F.when(F.length("_d") >= n, F.sequence(F.lit(1), F.length("_d") - n + 1))
        return F.coalesce(F.transform(starts, lambda i: F.substr("_d", i, F.lit(n))), F.array().cast("array<string>"))

    cut = F.explode(F.array_distinct(F.concat(*[grams(n) for n in lengths]) if lengths else F.array().cast("array<string>")))
    met = keys.select("*", cut.alias("_gram")).join(table, "_gram").filter(
        F.contains("_d", "_text")
        & (F.col("_debit").isNull() | (F.col("_debit") == F.col("_s")))
        & (F.col("_part").isNull() | F.contains("_a", "_part"))
    )
    found = met.groupBy("_d", "_s", "_a").agg(F.min("_rule").alias("_plain"))
    by_regex: Column | None = None
    for i, r in enumerate(rules):
        if r.get("use_regex"):
            cond = rule_condition(r)
            by_regex = F.when(cond, i) if by_regex is None else by_regex.when(cond, i)
    first = F.least("_plain", by_regex) if by_regex is not None else F.col("_plain")
    names = F.from_json(F.lit(json.dumps([r.get("category", DEFAULT_CATEGORY) for r in rules])), "array<string>")
    out = keyed.join(found, ["_d", "_s", "_a"], "left").withColumn("rule_category", F.get(names, first))
    return out.select(*df.columns, "rule_category")


def vocabulary(history: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """Distinct categories of history and rules, without the default."""
    own = sorted({r["category"] for r in rules if r.get("category")} - {DEFAULT_CATEGORY})
    named = history.sparkSession.createDataFrame([(c,) for c in own], "category string")
    return labelled(history).select("category").unionByName(named).distinct()


def cached_labels(cache: DataFrame, vocab: DataFrame) -> DataFrame:
    """Usable rows of the label cache (norm, is_debit, category)."""
    return cache.join(vocab, "category", "left_semi").select("norm", "is_debit", "category")


def lookup_cached(df: DataFrame, cache: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rows with their cached category, NULL when absent or off vocabulary."""
    usable = cached_labels(cache, vocab).withColumnRenamed("category", "cached_category")
    return (
        df.withColumn("norm", norm("description"))
        .withColumn("is_debit", is_debit("amount"))
        .join(usable, ["norm", "is_debit"], "left")
        .drop("norm", "is_debit")
    )


def categorize(
    df: DataFrame,
    index: CategoryIndex | None,
    rules: Sequence[dict],
    cache: DataFrame | None = None,
    vocab: DataFrame | None = None,
) -> DataFrame:
    """Exact > rule > fuzzy > cached label > default, with remarks and source.

    All keyed layers are united into one answer table first, so every row takes part in
    a single join. Fuzzy work is limited to keys no rule and no exact answer settles.
    """
    rows = match_rules(df, rules)
    if index is None:
        answered = rows.withColumn("answer", F.lit(None).cast("string")).withColumn(
            "found_by", F.lit(None).cast("string")
        )
    else:
        rows = rows.withColumn("norm", norm("description")).withColumn("is_debit", is_debit("amount"))
        keys = rows.filter("rule_category IS NULL").select("norm", "is_debit").distinct()
        answers = key_answers(keys, index).select("norm", "is_debit", "category", "found_by")
        if cache is not None and vocab is not None:
            cached = cached_labels(cache, vocab).join(answers, ["norm", "is_debit"], "left_anti")
            answers = answers.unionByName(cached.withColumn("found_by", F.lit("cached")))
        answered = rows.join(
            answers.withColumnRenamed("category", "answer"), ["norm", "is_debit"], "left"
        ).drop("norm", "is_debit")
    exact = F.col("found_by") == "exact"
    source = (
        F.when(exact, "exact")
        .when(F.col("rule_category").isNotNull(), "rule")
        .when(F.col("answer").isNotNull(), F.col("found_by"))
        .otherwise("default")
    )
    category = (
        F.when(exact, F.col("answer"))
        .when(F.col("rule_category").isNotNull(), F.col("rule_category"))
        .otherwise(F.coalesce("answer", F.lit(DEFAULT_CATEGORY)))
    )
    kept = [c for c in df.columns if c not in ("category", "remarks", "source")]
    remarks = F.col("remarks") if "remarks" in df.columns else F.lit("")
    out = answered.select(*kept, category.alias("category"), remarks.alias("remarks"), source.alias("source"))
    return flag_remarks(out)


def flag_remarks(df: DataFrame) -> DataFrame:
    """Review remark into blank remarks only."""
    remark = F.when(F.col("source").isin("fuzzy", "cached", "predicted"), LOW_CONFIDENCE_REMARK).when(
        F.col("category") == DEFAULT_CATEGORY, REVIEW_REMARK
    )
    return df.withColumn(
        "remarks", F.when(is_blank("remarks"), F.coalesce(remark, F.col("remarks"))).otherwise(F.col("remarks"))
    )


def categorize_stats(df: DataFrame) -> DataFrame:
    """K16"""
    return df.groupBy("source").agg(F.count("*").alias("rows"))


def apply_predictions(
    df: DataFrame, predictions: DataFrame, vocab: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Supplied labels per (norm, is_debit) onto still-default rows.

    Returns the rows and the accepted labels, which are what the cache gains.
    """
    accepted = (
        predictions.join(vocab, "category", "left_semi")
        .groupBy("norm", "is_debit")
        .agg(F.min("category").alias("predicted"))
    )
    rows = (
        df.withColumn("norm", norm("description"))
        .withColumn("is_debit", is_debit("amount"))
        .join(accepted, ["norm", "is_debit"], "left")
    )
    hit = (F.col("source") == "default") & F.col("predicted").isNotNull()
    review = F.trim(text_or_empty("remarks")).isin("", REVIEW_REMARK)
    out = rows.select(
        *[c for c in df.columns if c not in ("category", "source", "remarks")],
        F.when(hit, F.col("predicted")).otherwise(F.col("category")).alias("category"),
        F.when(hit & review, LOW_CONFIDENCE_REMARK).otherwise(F.col("remarks")).alias("remarks"),
        F.when(hit, "predicted").otherwise(F.col("source")).alias("source"),
    )
    return out.select(*df.columns), accepted.withColumnRenamed("predicted", "category")


def merge_cache(cache: DataFrame, accepted: DataFrame) -> DataFrame:
    """Accepted labels over the old cache, newest wins."""
    return (
        cache.withColumn("_gen", F.lit(0))
        .unionByName(accepted.withColumn("_gen", F.lit(1)))
        .groupBy("norm", "is_debit")
        .agg(F.max_by("category", "_gen").alias("category"))
    )


def score_batches(df: DataFrame, scorer, schema: str = "norm string, is_debit boolean, category string") -> DataFrame:
    """Hook for a user's batch scorer: an iterator of pandas frames in and out."""
    keys = df.select(norm("description").alias("norm"), is_debit("amount").alias("is_debit")).distinct()
    return keys.mapInPandas(scorer, schema)


def category_examples(history: DataFrame, vocab: DataFrame, history_order: str = "global") -> DataFrame:
    """Per category the first three descriptions with distinct norm.

    The first row of a norm is the least key, kept map-side; only these meet the vocabulary, so
    the rows of one category never meet in one task.
    """
    seen = first_seen_key(history_order)
    per_category = Window.partitionBy("category").orderBy("seen")
    return (
        labelled(history)
        .select("category", norm("description").alias("norm"), seen.alias("seen"))
        .filter("norm <> ''")
        .groupBy("category", "norm")
        .agg(F.min("seen").alias("seen"))
        .join(vocab, "category", "left_semi")
        .withColumn("position", F.row_number().over(per_category))
        .filter(F.col("position") <= EXAMPLES_PER_CATEGORY)
        .select(
            "category",
            "position",
            F.concat(
                F.lit('"'),
                F.substring("seen.description", 1, EXAMPLE_LENGTH),
                F.lit('" ['),
                F.when(is_debit("seen.amount"), "DEBIT").otherwise("CREDIT"),
                F.lit("]"),
            ).alias("example"),
        )
    )


def suggest_rules(history: DataFrame) -> DataFrame:
    """Frequent words per (category, sign) as rule suggestions.

    Counting runs as map-side partial sums; only the ten best words per group are
    shuffled for the ranking. Word ties go to the row and position seen first.
    """
    words = (
        labelled(history)
        .filter(F.col("amount").isNotNull())
        .select(
            "category",
            is_debit("amount").alias("debit"),
            first_seen_key("global").alias("seen"),
            F.posexplode(
                F.regexp_extract_all(F.lower(text_or_empty("description")), F.lit(r"\b([a-z0-9]{3,})\b"), 1)
            ).alias("pos", "word"),
        )
        .filter(~F.col("word").rlike("^[0-9]+$"))
        .groupBy("category", "debit", "word")
        .agg(F.count("*").alias("n"), F.min(F.struct("seen", "pos")).alias("seen"))
    )
    best = Window.partitionBy("category", "debit").orderBy(F.desc("n"), "seen")
    return (
        words.withColumn("_rank", F.row_number().over(best))
        .filter((F.col("_rank") <= KEYWORDS_PER_RULE) & (F.col("n") >= KEYWORD_MIN_COUNT))
        .groupBy("category", "debit")
        .agg(F.array_sort(F.collect_list("word")).alias("description"))
    )
