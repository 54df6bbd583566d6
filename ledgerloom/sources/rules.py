"""Rule and configuration files (S6). They are small and ordered, and shape the plan."""

from __future__ import annotations

import json
import logging
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.dates import datetime_pattern
from ledgerloom.schema import PARSING_CONFIG

log = logging.getLogger(__name__)


class RuleError(ValueError):
    """A rule file the engine must not run with."""


def _texts(spark: SparkSession, path: str, name_pattern: str = "*.json") -> list[tuple[str, str]]:
    rows = (
        spark.read.option("wholetext", True).option("pathGlobFilter", name_pattern).text(path)
        .select(F.col("_metadata.file_name").alias("name"), "value")
        .collect()
    )
    return [(r.name, r.value) for r in rows]


def _json(spark: SparkSession, path: str):
    texts = _texts(spark, path, "*")
    return json.loads("".join(v for _, v in texts))


def check_matchers(rules) -> list[dict]:
    """An ordered category rule list; anything unusable is fatal."""
    if not isinstance(rules, list) or not rules:
        raise RuleError("category rules must be a non-empty list")
    for r in rules:
        patterns = r.get("description", [])
        if not isinstance(patterns, list):
            raise RuleError(f"rule 'description' must be a list: {r}")
        if not isinstance(r.get("category", ""), str):
            raise RuleError(f"rule category must be text: {r}")
        if r.get("use_regex"):
            for p in patterns:
                try:
                    re.compile(str(p))
                except re.error as e:
                    raise RuleError(f"invalid pattern {p!r}: {e}") from e
    return rules


def check_patterns(spark: SparkSession, rules: list[dict]) -> list[dict]:
    """Patterns must also compile where they run, on the JVM; a refused one is fatal here."""
    compiler = spark._jvm.java.util.regex.Pattern
    for r in rules:
        for p in r.get("description", []) if r.get("use_regex") else ():
            try:
                compiler.compile(f"(?i){p}")
            except Exception as e:
                raise RuleError(f"invalid pattern {p!r} for Spark: {str(e).splitlines()[0]}") from e
    return rules


def load_matchers(spark: SparkSession, path: str) -> list[dict]:
    return check_patterns(spark, check_matchers(_json(spark, path)))


def load_ignore(spark: SparkSession, path: str) -> list[dict]:
    """Ignore rules; a missing or broken file means none."""
    try:
        rules = _json(spark, path)
    except Exception as e:  # unreadable in any way
        log.warning("no ignore rules from %s: %s", path, e)
        return []
    return rules if isinstance(rules, list) else []


def check_directions(data) -> dict[str, str]:
    """Mirror map with directions lower-cased; entries that are neither in nor out drop."""
    if not isinstance(data, dict):
        return {}
    lowered = {str(k): str(v).strip().lower() for k, v in data.items()}
    return {k: v for k, v in lowered.items() if v in ("in", "out")}


def load_cash_mirror(spark: SparkSession, path: str) -> dict[str, str]:
    try:
        return check_directions(_json(spark, path))
    except Exception as e:  # unreadable in any way
        log.warning("no cash mirror map from %s: %s", path, e)
        return {}


def parsing_configs(spark: SparkSession, configs: dict[str, dict]) -> DataFrame:
    """Configurations as a table, date formats translated to Spark patterns."""
    rows = [
        (
            key,
            c.get("header_patterns", []),
            c["column_map"],
            [datetime_pattern(f) for f in c.get("date_formats", [])],
            c.get("amount_sign_col"),
            str(c.get("debit_value", "")),
            c.get("special_handling"),
            c.get("statement_period_patterns", []),
        )
        for key, c in configs.items()
    ]
    return spark.createDataFrame(rows, PARSING_CONFIG)


def load_parsing_configs(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per ``{kind}-{bank}`` key in a folder."""
    return parsing_configs(spark, {n[: -len(".json")]: json.loads(v) for n, v in _texts(spark, path)})


def account_table(spark: SparkSession, bank: list[str], cc: list[str]) -> DataFrame:
    rows = [("bank", a, i) for i, a in enumerate(bank)] + [("cc", a, i) for i, a in enumerate(cc)]
    return spark.createDataFrame(rows, "kind string, account string, idx int")
