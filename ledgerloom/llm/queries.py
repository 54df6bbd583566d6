"""Registered queries of the corpus operators and, where SQL can say it, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (
    decontaminate,
    importance,
    lexical,
    linededup,
    neighbours,
    packing,
    quality,
    shards,
    simhash,
    tokenfile,
    topk,
    toxicity,
    urls,
)
from ledgerloom.llm.tokens import vocabulary_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def fold(i: str, parts: int):
    """crc32 of the id's text, modulo ``parts``."""
    return F.crc32(F.col(i).cast("string").cast("binary")) % parts


@query("op1_quality_classifier")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train_quality(docs, labels.filter(fold("doc_id", 5) != 0))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query("op2_decontamination")
def contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    # Every item of a class of equal texts has a row of its own.
    return found.select("doc_id", F.explode_outer("item_ids").alias("item_id"), "containment")


@query("op3_best_fit_packing")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())


@query("op4_simhash_near_dedup")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = toxicity.train_toxicity(docs, labels.filter(fold("doc_id", 4) != 2))
    scored = toxicity.score_toxicity(docs, net)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


@query(
    "op6_exact_top_k",
    """WITH rows AS MATERIALIZED (
      SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (
      SELECT q.n, q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM rows q JOIN rows c ON q.vec_id % 20 = 0 AND q.n <> c.n)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM pairs) r WHERE rank <= 20""",
)
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"))


_RULES_SQL = ", ".join(f"('{r}', '{v}')" for r, v in URL_RULES)
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query(
    "op7_url_filters",
    f"""WITH rules(rule, verdict) AS (VALUES {_RULES_SQL}),
    parts AS (
      SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages),
    split AS (
      SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(tail, '^([^/?#]*)', 1), {_AZ}) AS host,
             regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
    fitting AS (
      SELECT s.n, r.rule, r.verdict FROM split s, rules r
      WHERE (s.host = split_part(r.rule, '/', 1) OR ends_with(s.host, '.' || split_part(r.rule, '/', 1)))
        AND starts_with(s.path, substr(r.rule, instr(r.rule, '/')))),
    best AS (SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fitting GROUP BY n)
    SELECT s.page_id, s.host, s.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM split s LEFT JOIN best b USING (n)""",
)
def judged_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules)


@query("op8_sharding")
def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


_KEY_SQL = f"translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_AZ})"


@query(
    "op9_line_dedup",
    f"""WITH lines AS (
      SELECT n, doc_id, pos, string_split(t, chr(10))[pos] AS line FROM (
        SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents) d,
        unnest(generate_series(1, CAST(len(string_split(t, chr(10))) AS BIGINT))) AS u(pos)),
    keyed AS (SELECT *, {_KEY_SQL} AS key FROM lines),
    frequent AS (
      SELECT key FROM (SELECT DISTINCT doc_id, CASE WHEN doc_id IS NULL THEN n END AS own, key FROM keyed WHERE length(key) >= 1) k GROUP BY key HAVING count(*) >= 10),
    marked AS (SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON f.key = k.key)
    SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY n, doc_id""",
)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


@query("op10_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = tokenfile.token_folder(spark)
    tokenfile.write_token_files(table(spark, sf_dir, "documents"), vocabulary_path(), where)
    return tokenfile.read_token_files(spark, where)


@query("op11_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@query("op12_importance_resampling")
def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM_SQL = "unnest(regexp_extract_all(translate(coalesce(text, ''), {az}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))".format(az=_AZ)


@query(
    "op13_lexical_search",
    f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
    terms AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, {_TERM_SQL} AS term FROM d) x GROUP BY r, term),
    sizes AS MATERIALIZED (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM terms GROUP BY r),
    facts AS MATERIALIZED (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
    wanted AS MATERIALIZED (
      SELECT i, item_id, term, count(*) AS repeats
      FROM (SELECT i, item_id, {_TERM_SQL} AS term FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark) b) x
      GROUP BY i, item_id, term),
    weights AS MATERIALIZED (
      SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM terms GROUP BY term) f, facts),
    scored AS (
      SELECT i, item_id, r, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score
      FROM wanted JOIN terms USING (term) JOIN weights USING (term) JOIN sizes USING (r), facts GROUP BY i, item_id, r),
    ranked AS (
      SELECT i, item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank
      FROM scored JOIN d USING (r) WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
)
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
