"""Duplicate elimination and categorisation."""

from pyspark.sql import functions as F

from ledgerloom.checks.fragments import (
    DOCS,
    EXACT,
    HISTORY,
    IDF,
    IGNORE,
    INCOMING_KEYS,
    RULES,
    SPLIT,
    VOTES,
    alnum,
    cut,
    labelled,
    norm,
    queries_of,
    refs,
    rule_case,
    signature,
    tokens,
    with_views,
)
from ledgerloom.checks.registry import query
from ledgerloom.checks.views import Inputs
from ledgerloom.functions import text
from ledgerloom.operators import categorize, category_index, dedup

_INCOMING = with_views("incoming")
_LEDGER = with_views("ledger")
_INDEX = (HISTORY, VOTES, EXACT, IDF, DOCS)
_KIND = "CASE WHEN lower(trim({0})) LIKE 'bank%' THEN 'bank' WHEN lower(trim({0})) LIKE 'cc%' THEN 'cc' ELSE 'unknown' END"


@query(
    "d1_desc_signature",
    _INCOMING
    + f"""SELECT txn_date, account, description, amount, CASE WHEN len({refs('description')}) > 0 THEN 'ref' ELSE 'txt' END AS kind,
  array_to_string({refs('description')}, ',') AS refs,
  CASE WHEN len({refs('description')}) > 0 THEN '' ELSE {alnum(cut('description'))} END AS txt,
  CASE WHEN len({refs('description')}) > 0 THEN lower(regexp_extract(description, '\\b([csiCSI][gG][sS][tT])\\b', 1)) ELSE '' END AS gst
FROM incoming""",
)
def _(t: Inputs):
    return dedup.description_signatures(t.incoming)


@query("d2_txn_key", _INCOMING + f"SELECT *, {signature('description')} AS signature FROM incoming")
def _(t: Inputs):
    return dedup.txn_key(t.incoming)


_NEW = with_views(
    "ledger", "incoming",
    extra=(HISTORY, f"""keyed AS (SELECT *, {signature('description')} AS signature FROM incoming),
known AS (SELECT DISTINCT txn_date, account, amount, {signature('description')} AS signature FROM history)"""),
)
_FIRST = """SELECT k.txn_date, k.account, k.description, k.amount FROM (
  SELECT *, row_number() OVER (PARTITION BY txn_date, account, amount, signature ORDER BY description) AS rk FROM keyed) k
LEFT JOIN known o ON o.txn_date = k.txn_date AND o.account = k.account AND o.amount = k.amount AND o.signature = k.signature
WHERE k.rk = 1 AND o.account IS NULL"""


@query("d3_find_new", _NEW + _FIRST)
def _(t: Inputs):
    return dedup.find_new(t.history, t.incoming)


@query(
    "d4_cold_start",
    _NEW + f"{_FIRST} AND k.account LIKE 'bank%' UNION ALL SELECT txn_date, account, description, amount FROM incoming WHERE account LIKE 'cc%'",
)
def _(t: Inputs):
    return dedup.find_new(t.history.filter(F.col("account").startswith("bank")), t.incoming)


@query(
    "d5_drop_ignored",
    _INCOMING
    + f"""SELECT * FROM incoming WHERE NOT (contains({alnum('description')}, 'redwidget')
  OR (contains({alnum('description')}, 'oldrod') AND account = 'bank-brand3'))""",
)
def _(t: Inputs):
    return dedup.drop_ignored(t.incoming, IGNORE)


@query("d6_uncategorised", _LEDGER + f"SELECT * FROM ledger WHERE NOT {labelled()}")
def _(t: Inputs):
    return dedup.uncategorised(t.ledger)


@query("d7_labelled", _LEDGER + f"SELECT * FROM ledger WHERE {labelled()}")
def _(t: Inputs):
    return dedup.labelled(t.ledger)


@query("d8_route", _LEDGER + f"SELECT *, {_KIND.format('account')} AS ledger FROM ledger")
def _(t: Inputs):
    return dedup.route(t.ledger)


@query("k1_norm", _INCOMING + f"SELECT description, {norm('description')} AS norm FROM incoming")
def _(t: Inputs):
    return t.incoming.select("description", text.norm("description").alias("norm"))


@query(
    "k2_tokens",
    _INCOMING + f"SELECT description, array_to_string({tokens(norm('description'))}, ',') AS tokens FROM incoming",
)
def _(t: Inputs):
    return t.incoming.select("description", F.array_join(text.tokens("description"), ",").alias("tokens"))


@query("k3_is_debit", _INCOMING + "SELECT description, amount, amount < 0 AS is_debit FROM incoming")
def _(t: Inputs):
    return t.incoming.select("description", "amount", text.is_debit("amount").alias("is_debit"))


@query(
    "k4_build_exact",
    with_views("ledger", extra=_INDEX[:3]) + "SELECT norm, is_debit, category, CAST(total_votes AS BIGINT) AS total_votes FROM exact",
)
def _(t: Inputs):
    exact = category_index.build_exact(category_index.count_votes(t.history))
    return exact.select("norm", "is_debit", "category", "total_votes")


@query(
    "k5_vote_confidence",
    with_views("ledger", extra=_INDEX[:3]) + "SELECT norm, is_debit, round(confidence, 9) AS confidence FROM exact",
)
def _(t: Inputs):
    exact = category_index.build_exact(category_index.count_votes(t.history))
    return exact.select("norm", "is_debit", F.round("confidence", 9).alias("confidence"))


@query(
    "k6_build_idf",
    with_views("ledger", extra=_INDEX[:4]) + "SELECT token, CAST(df AS BIGINT) AS df, round(idf, 9) AS idf FROM idf",
)
def _(t: Inputs):
    idf = category_index.build_idf(category_index.count_votes(t.history))
    return idf.select("token", "df", F.round("idf", 9).alias("idf"))


@query(
    "k7_build_docs",
    with_views("ledger", extra=_INDEX)
    + """SELECT s.is_debit, array_to_string(s.token_set, ',') AS tokens, round(d.length, 9) AS length
FROM (SELECT DISTINCT is_debit, token_set FROM sets) s JOIN doc_len d ON d.token_set = s.token_set""",
)
def _(t: Inputs):
    docs = category_index.build_index(t.history).docs
    return docs.select("is_debit", F.array_join("token_set", ",").alias("tokens"), F.round("length", 9).alias("length"))


_FUZZY = with_views("ledger", "incoming", extra=(*_INDEX, queries_of(INCOMING_KEYS)))


def _queries(t: Inputs):
    index = category_index.build_index(t.history)
    keys = category_index.query_keys(t.incoming)
    return keys, index, category_index.query_vectors(keys, index.idf)


@query(
    "k8_query_vectors",
    _FUZZY + "SELECT norm, is_debit, token, round(weight, 9) AS weight FROM q_terms",
)
def _(t: Inputs):
    _, _, vectors = _queries(t)
    return vectors.select("norm", "is_debit", F.explode("q_terms").alias("x")).select(
        "norm", "is_debit", "x.token", F.round("x.weight", 9).alias("weight")
    )


@query(
    "k9_fuzzy_scores",
    _FUZZY
    + "SELECT norm, is_debit, array_to_string(token_set, ',') AS tokens, round(similarity, 9) AS similarity FROM scores WHERE similarity >= 0.8",
)
def _(t: Inputs):
    _, index, vectors = _queries(t)
    return category_index.fuzzy_scores(vectors, index.docs).select(
        "norm", "is_debit", F.array_join("token_set", ",").alias("tokens"), F.round("similarity", 9).alias("similarity")
    )


@query(
    "k10_fuzzy_topk",
    _FUZZY + "SELECT norm, is_debit, CAST(rank AS INTEGER) AS rank, round(similarity, 9) AS similarity, category FROM top3",
)
def _(t: Inputs):
    _, index, vectors = _queries(t)
    return category_index.fuzzy_topk(vectors, index.docs).select(
        "norm", "is_debit", "rank", F.round("similarity", 9).alias("similarity"), "category"
    )


@query(
    "k11_fuzzy_lookup",
    _FUZZY + "SELECT norm, is_debit, round(confidence, 9) AS confidence, category FROM fuzzy",
)
def _(t: Inputs):
    keys, index, _ = _queries(t)
    return category_index.fuzzy_lookup(keys, index).select(
        "norm", "is_debit", F.round("confidence", 9).alias("confidence"), "category"
    )


_ANSWERED = f"""answered AS (
  SELECT i.*, {norm('i.description')} AS norm, i.amount < 0 AS is_debit, {rule_case('i.description', 'i.amount', 'i.account')} AS by_rule,
         e.category AS by_exact, e.confidence AS exact_confidence, f.category AS by_fuzzy, f.confidence AS fuzzy_confidence
  FROM incoming i
  LEFT JOIN exact e ON e.norm = {norm('i.description')} AND e.is_debit = (i.amount < 0)
  LEFT JOIN fuzzy f ON f.norm = {norm('i.description')} AND f.is_debit = (i.amount < 0)),
categorised AS (
  SELECT txn_date, account, description, amount,
         CASE WHEN by_exact IS NOT NULL AND EXACT_COUNTS THEN 'exact' WHEN by_rule IS NOT NULL THEN 'rule'
              WHEN by_fuzzy IS NOT NULL THEN 'fuzzy' ELSE 'default' END AS source,
         coalesce(by_exact, by_rule, by_fuzzy, 'Uncategorized') AS category
  FROM answered)""".replace("EXACT_COUNTS", "TRUE")
_LAYERED = with_views("ledger", "incoming", extra=(*_INDEX, queries_of(INCOMING_KEYS), _ANSWERED))
_REMARKED = """SELECT txn_date, account, description, amount, category, source,
  CASE WHEN source = 'fuzzy' THEN 'REVIEW: low-confidence auto-category'
       WHEN category = 'Uncategorized' THEN 'REVIEW: auto-categorization uncertain' ELSE '' END AS remarks FROM categorised"""


@query(
    "k12_lookup",
    _LAYERED
    + """SELECT txn_date, account, description, amount, coalesce(by_exact, by_fuzzy) AS found_category,
  round(coalesce(exact_confidence, fuzzy_confidence, 0.0), 9) AS confidence,
  CASE WHEN by_exact IS NOT NULL THEN 'exact' WHEN by_fuzzy IS NOT NULL THEN 'fuzzy' END AS found_by FROM answered""",
)
def _(t: Inputs):
    found = category_index.lookup(t.incoming, category_index.build_index(t.history))
    return found.withColumn("confidence", F.round("confidence", 9))


@query("k13_match_rules", _INCOMING + f"SELECT *, {rule_case()} AS rule_category FROM incoming")
def _(t: Inputs):
    return categorize.match_rules(t.incoming, RULES)


def _categorised(t: Inputs):
    return categorize.categorize(t.incoming, category_index.build_index(t.history), RULES)


@query("k14_categorize", _LAYERED + _REMARKED)
def _(t: Inputs):
    return _categorised(t)


@query(
    "k15_flag_remarks",
    _LEDGER
    + """SELECT txn_date, account, description, amount, category, source,
  CASE WHEN txn_date >= DATE '1995-01-01' THEN 'seen' WHEN source = 'fuzzy' THEN 'REVIEW: low-confidence auto-category'
       WHEN category = 'Uncategorized' THEN 'REVIEW: auto-categorization uncertain' ELSE ' ' END AS remarks
FROM (SELECT *, CASE WHEN amount < -5000 THEN 'fuzzy' ELSE 'rule' END AS source FROM ledger) l""",
)
def _(t: Inputs):
    rows = t.ledger.withColumn("source", F.expr("CASE WHEN amount < -5000 THEN 'fuzzy' ELSE 'rule' END"))
    rows = rows.withColumn("remarks", F.expr("CASE WHEN txn_date >= DATE '1995-01-01' THEN 'seen' ELSE ' ' END"))
    return categorize.flag_remarks(rows)


@query("k16_categorize_stats", _LAYERED + "SELECT source, count(*) AS rows FROM categorised GROUP BY source")
def _(t: Inputs):
    return categorize.categorize_stats(_categorised(t))


_NAMES = ", ".join(f"('{r['category']}')" for r in RULES if r.get("category"))
_VOCABULARY = f"""vocabulary AS (
  SELECT DISTINCT category FROM history WHERE {labelled()} UNION SELECT category FROM (VALUES {_NAMES}) v(category))"""


@query("k17_vocabulary", with_views("ledger", extra=(HISTORY, _VOCABULARY)) + "SELECT category FROM vocabulary")
def _(t: Inputs):
    return categorize.vocabulary(t.history, RULES)


# A label cache over the keys of the ledger; every third label is off vocabulary.
_CACHE = f"""cache AS (
  SELECT DISTINCT {norm('description')} AS norm, amount < 0 AS is_debit,
         CASE WHEN length({norm('description')}) % 3 = 0 THEN 'Off:List' ELSE 'Expense:Gear' END AS category FROM ledger)"""


def _cache(t: Inputs):
    n = text.norm("description")
    return t.ledger.select(
        n.alias("norm"), text.is_debit("amount").alias("is_debit"),
        F.when(F.length(n) % 3 == 0, "Off:List").otherwise("Expense:Gear").alias("category"),
    ).distinct()


@query(
    "k18_cached_labels",
    with_views("ledger", "incoming", extra=(HISTORY, _VOCABULARY, _CACHE))
    + f"""SELECT i.*, c.category AS cached_category FROM incoming i
LEFT JOIN (SELECT * FROM cache WHERE category IN (SELECT category FROM vocabulary)) c
  ON c.norm = {norm('i.description')} AND c.is_debit = (i.amount < 0)""",
)
def _(t: Inputs):
    return categorize.lookup_cached(t.incoming, _cache(t), categorize.vocabulary(t.history, RULES))


@query(
    "k19_apply_predictions",
    with_views("ledger", "incoming", extra=(*_INDEX, queries_of(INCOMING_KEYS), _ANSWERED, _VOCABULARY, _CACHE))
    + f"""SELECT r.txn_date, r.account, r.description, r.amount,
  CASE WHEN r.source = 'default' AND c.category IS NOT NULL THEN c.category ELSE r.category END AS category,
  CASE WHEN r.source = 'default' AND c.category IS NOT NULL THEN 'REVIEW: low-confidence auto-category' ELSE r.remarks END AS remarks,
  CASE WHEN r.source = 'default' AND c.category IS NOT NULL THEN 'predicted' ELSE r.source END AS source
FROM ({_REMARKED}) r LEFT JOIN (SELECT * FROM cache WHERE category IN (SELECT category FROM vocabulary)) c
  ON c.norm = {norm('r.description')} AND c.is_debit = (r.amount < 0)""",
)
def _(t: Inputs):
    return categorize.apply_predictions(_categorised(t), _cache(t), categorize.vocabulary(t.history, RULES))[0]


@query(
    "k20_index_add",
    with_views("ledger")
    + f"""SELECT {norm('description')} AS norm, amount < 0 AS is_debit, category, count(*) AS votes
FROM ledger WHERE {labelled()} AND {norm('description')} <> '' GROUP BY 1, 2, 3""",
)
def _(t: Inputs):
    later = t.ledger.filter(F.col("txn_date") >= F.expr(SPLIT))
    index = category_index.index_add(category_index.build_index(t.history), later)
    return index.votes.select("norm", "is_debit", "category", "votes")


@query(
    "k21_category_examples",
    with_views("ledger", extra=(HISTORY,))
    + f"""SELECT category, CAST(position AS INTEGER) AS position, '"' || substr(description, 1, 60) || '" [' || CASE WHEN amount < 0 THEN 'DEBIT' ELSE 'CREDIT' END || ']' AS example
FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY txn_date, account, amount, description) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY category, norm ORDER BY txn_date, account, amount, description) AS rk FROM (
    SELECT *, {norm('description')} AS norm FROM history WHERE {labelled()}) n WHERE norm <> '') r WHERE rk = 1) p WHERE position <= 3""",
)
def _(t: Inputs):
    return categorize.category_examples(t.history, categorize.vocabulary(t.history, []))


@query(
    "k22_suggest_rules",
    with_views("ledger", extra=(HISTORY,))
    + f"""SELECT category, debit, array_to_string(list_sort(list(word)), ',') AS words FROM (
  SELECT *, row_number() OVER (PARTITION BY category, debit ORDER BY n DESC, seen, pos) AS rk FROM (
    SELECT category, debit, word, count(*) AS n, min(struct_pack(a := txn_date, b := account, c := amount, d := description, e := pos)) AS seen, 0 AS pos FROM (
      SELECT *, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM (
        SELECT *, amount < 0 AS debit, regexp_extract_all(lower(description), '\\b([a-z0-9]{{3,}})\\b') AS words FROM history WHERE {labelled()}) h) w
    WHERE NOT regexp_full_match(word, '[0-9]+') GROUP BY category, debit, word) c) r WHERE rk <= 10 AND n >= 3 GROUP BY category, debit""",
)
def _(t: Inputs):
    return categorize.suggest_rules(t.history).select("category", "debit", F.array_join("description", ",").alias("words"))
