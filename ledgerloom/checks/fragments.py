"""SQL texts the oracles share (DuckDB dialect)."""

from ledgerloom.checks.views import AS_OF, HISTORY_END, cte

DAY = f"DATE '{AS_OF}'"
SPLIT = f"DATE '{HISTORY_END}'"


def norm(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[0-9]+', '#', 'g'), "
        "'[^a-z#/ ]', ' ', 'g'), '\\s+', ' ', 'g'))"
    )


def tokens(n: str) -> str:
    return f"list_filter(string_split(replace({n}, '/', ' '), ' '), lambda t: length(t) >= 3)"


def alnum(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]', '', 'g')"


def refs(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_extract_all({x}, '[0-9]+'), lambda d: length(d) = 12)))"


def signature(x: str) -> str:
    return (
        f"CASE WHEN len({refs(x)}) > 0 "
        f"THEN 'ref|' || array_to_string({refs(x)}, ',') || '||' || lower(regexp_extract({x}, '\\b([csiCSI][gG][sS][tT])\\b', 1)) "
        f"ELSE 'txt||' || {alnum(cut(x))} || '|' END"
    )


def cut(x: str) -> str:
    return f"regexp_replace({x}, '\\s+(?:value dt|ref)\\b.*$', '', 'i')"


def labelled(c: str = "category") -> str:
    return f"({c} IS NOT NULL AND trim({c}) <> '' AND {c} <> 'Uncategorized')"


HISTORY = f"history AS (SELECT * FROM ledger WHERE txn_date < {SPLIT})"

VOTES = f"""votes AS (
  SELECT {norm('description')} AS norm, amount < 0 AS is_debit, category, count(*) AS votes,
         min(struct_pack(a := txn_date, b := account, c := amount, d := description)) AS first_seen
  FROM history WHERE {labelled()} AND {norm('description')} <> '' GROUP BY 1, 2, 3)"""

EXACT = """exact AS (
  SELECT norm, is_debit, category, votes / total AS confidence, total AS total_votes FROM (
    SELECT *, sum(votes) OVER (PARTITION BY norm, is_debit) AS total,
           row_number() OVER (PARTITION BY norm, is_debit ORDER BY votes DESC, first_seen) AS rk FROM votes) v WHERE rk = 1)"""

IDF = f"""sets AS (
  SELECT is_debit, list_sort(list_distinct({tokens('norm')})) AS token_set, category, sum(votes) AS n
  FROM votes WHERE len({tokens('norm')}) > 0 GROUP BY 1, 2, 3),
idf AS (
  SELECT token, sum(n) AS df, ln((SELECT sum(n) FROM sets) / sum(n)) AS idf
  FROM (SELECT unnest(token_set) AS token, n FROM sets) t GROUP BY token)"""

DOCS = """doc_terms AS (
  SELECT s.token_set, t.token, i.idf FROM (SELECT DISTINCT token_set FROM sets) s, unnest(s.token_set) AS t(token) JOIN idf i ON i.token = t.token),
doc_len AS (
  SELECT token_set, CASE WHEN sum(idf * idf) > 0 THEN sqrt(sum(idf * idf)) ELSE 1.0 END AS length FROM doc_terms GROUP BY token_set)"""


def queries_of(keys: str) -> str:
    """Query vectors of ``keys(norm, is_debit)``."""
    return f"""keys AS ({keys}),
q_terms AS (
  SELECT k.norm, k.is_debit, t.token, count(*) * i.idf AS weight, i.idf
  FROM keys k, unnest({tokens('k.norm')}) AS t(token) JOIN idf i ON i.token = t.token GROUP BY k.norm, k.is_debit, t.token, i.idf),
q_len AS (
  SELECT norm, is_debit, CASE WHEN sum(weight * weight) > 0 THEN sqrt(sum(weight * weight)) ELSE 1.0 END AS length
  FROM q_terms GROUP BY norm, is_debit),
scores AS (
  SELECT q.norm, q.is_debit, d.token_set, round(sum(q.weight * d.idf) / (ql.length * dl.length), 12) AS similarity
  FROM q_terms q JOIN doc_terms d ON d.token = q.token
  JOIN (SELECT DISTINCT is_debit, token_set FROM sets) s ON s.token_set = d.token_set AND s.is_debit = q.is_debit
  JOIN q_len ql ON ql.norm = q.norm AND ql.is_debit = q.is_debit
  JOIN doc_len dl ON dl.token_set = d.token_set
  GROUP BY q.norm, q.is_debit, d.token_set, ql.length, dl.length),
ranked AS (
  SELECT *, sum(n) OVER w - n AS before FROM (SELECT c.norm, c.is_debit, c.similarity, s.category, s.n, s.token_set
     FROM scores c JOIN sets s ON s.token_set = c.token_set AND s.is_debit = c.is_debit) x
  WINDOW w AS (PARTITION BY norm, is_debit ORDER BY similarity DESC, category DESC, token_set ROWS UNBOUNDED PRECEDING)),
top3 AS (
  SELECT norm, is_debit, similarity, category, before + i AS rank
  FROM ranked, unnest(generate_series(1, CAST(least(n, 3) AS BIGINT))) AS u(i) WHERE before + i <= 3),
fuzzy AS (
  SELECT norm, is_debit, max(similarity) AS confidence, min(category) AS category FROM top3
  GROUP BY norm, is_debit HAVING max(similarity) >= 0.8 AND count(DISTINCT category) = 1)"""


INCOMING_KEYS = f"SELECT DISTINCT {norm('description')} AS norm, amount < 0 AS is_debit FROM incoming"


def with_views(*names: str, extra: tuple[str, ...] = ()) -> str:
    return ",\n".join([cte(*names), *extra]) + "\n"


# Rules over words of the descriptions; the order matters.
RULES = [
    {"category": "Expense:Hardware", "debit": True, "use_regex": True, "description": ["\\bbolt\\b", "^hot anvil"]},
    {"category": "Income:Refund", "debit": False, "description": ["PAYOUT"]},
    {"category": "Bills:Rods", "account": "BANK-brand1", "description": ["rod "]},
    {"category": "Transfer:Cash", "debit": True, "description": ["upi-red", "upi-hot"]},
    {"category": "Transfer:Cash Deposit", "debit": False, "description": ["upi-old"]},
    {"category": "Expense:Gear", "use_regex": True, "description": ["gear.*(economy|promo)"]},
    {"category": "Bills:Plates", "account": "cc-", "description": ["plate"]},
    {"category": "Expense:Any", "debit": True, "description": ["cold widget", "blue"]},
    {"description": ["new gizmo"]},
    {"category": "Expense:Small", "description": ["small"]},
]


def rule_case(desc: str = "description", amount: str = "amount", account: str = "account") -> str:
    d, a, debit = f"lower({desc})", f"lower({account})", f"({amount} < 0)"
    return f"""CASE
  WHEN {debit} AND (regexp_matches({d}, '\\bbolt\\b') OR regexp_matches({d}, '^hot anvil')) THEN 'Expense:Hardware'
  WHEN NOT {debit} AND contains({d}, 'payout') THEN 'Income:Refund'
  WHEN contains({a}, 'bank-brand1') AND contains({d}, 'rod ') THEN 'Bills:Rods'
  WHEN {debit} AND (contains({d}, 'upi-red') OR contains({d}, 'upi-hot')) THEN 'Transfer:Cash'
  WHEN NOT {debit} AND contains({d}, 'upi-old') THEN 'Transfer:Cash Deposit'
  WHEN regexp_matches({d}, 'gear.*(economy|promo)') THEN 'Expense:Gear'
  WHEN contains({a}, 'cc-') AND contains({d}, 'plate') THEN 'Bills:Plates'
  WHEN {debit} AND (contains({d}, 'cold widget') OR contains({d}, 'blue')) THEN 'Expense:Any'
  WHEN contains({d}, 'new gizmo') THEN 'Uncategorized'
  WHEN contains({d}, 'small') THEN 'Expense:Small' END"""


MIRROR = {"Transfer:Cash": "in", "Transfer:Cash Deposit": "out", "Expense:SMALL": "in", "Expense:PROMO": "out"}
IGNORE = [
    {"description_contains": "RED-WID GET"},
    {"description_contains": "old rod", "account": "bank-brand3"},
    {"description_contains": "  "},
]
