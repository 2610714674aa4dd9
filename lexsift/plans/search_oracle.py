"""SQL for DuckDB that gives the rows of the registered search queries."""

from __future__ import annotations

from collections import Counter

from . import search_queries as q

BASE = """
WITH reviews AS (
  SELECT CAST(d.doc_id + 1 AS INTEGER) AS review_id, d.source AS product_id, d.text,
         CAST(coalesce(1 + 4 * l.quality, 3) AS TINYINT) AS score,
         CAST(coalesce(e.clicks, 0) AS SMALLINT) AS help_num, CAST(coalesce(e.seen, 0) AS SMALLINT) AS help_den
  FROM documents d
  LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id
  LEFT JOIN (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) AS seen
             FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id) e ON e.user_id = d.doc_id),
split AS (
  SELECT review_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS words FROM reviews),
lengths AS (SELECT review_id, CAST(len(words) AS BIGINT) AS length FROM split),
postings AS (SELECT token, review_id, count(*) AS tf FROM (SELECT review_id, unnest(words) AS token FROM split) GROUP BY token, review_id),
lexicon AS (SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM postings GROUP BY token),
numbered AS (SELECT CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS token_id, token FROM lexicon),
gaps AS (SELECT token, review_id, tf, CAST(review_id - lag(review_id, 1, 0) OVER (PARTITION BY token ORDER BY review_id) AS INTEGER) AS gap FROM postings),
bigrams AS (SELECT DISTINCT substring('$' || token || '$', i, 2) AS bigram, token FROM (SELECT token, unnest(range(1, length(token) + 2)) AS i FROM lexicon)),
totals AS (SELECT (SELECT count(*) FROM reviews) AS n, (SELECT sum(cf) FROM lexicon) AS t)
"""


def _list(values) -> str:
    return ", ".join("(" + str(v) + ")" if isinstance(v, int) else "('" + v + "')" for v in values)


def _fits(term: str, column: str = "token") -> str:
    return f"{column} LIKE '{term.lower().replace('*', '%')}'" if "*" in term else f"{column} = '{term.lower()}'"


def _terms(terms) -> str:
    """CTE matched(term, token, df, cf) of tokens that fit each term."""
    unique = list(dict.fromkeys(t.lower() for t in terms))
    return ", terms(term) AS (VALUES " + _list(unique) + "), matched AS (" + " UNION ALL ".join(f"SELECT '{t}' AS term, token, df, cf FROM lexicon WHERE {_fits(t)}" for t in unique) + ")"


def _frequency(terms, column: str) -> str:
    return BASE + _terms(terms) + f" SELECT term, CAST(coalesce((SELECT sum({column}) FROM matched m WHERE m.term = terms.term), 0) AS BIGINT) AS {column} FROM terms"


def _reviews_with(terms) -> str:
    return BASE + _terms(terms) + " SELECT term, review_id, CAST(sum(tf) AS BIGINT) AS tf FROM matched JOIN postings USING (token) GROUP BY term, review_id"


def _expand(terms) -> str:
    return BASE + _terms(terms) + " SELECT term, token FROM matched"


def _weights(query) -> str:
    """CTEs on top of matched: weighed(term, qtf, df, cf, w)."""
    counts = Counter(t.lower() for t in query)
    values = ", ".join(f"('{t}', {n})" for t, n in sorted(counts.items()))
    return (
        _terms(query)
        + f""", qtf(term, qtf) AS (VALUES {values}),
known AS (SELECT q.term, q.qtf, CAST(coalesce(sum(m.df), 0) AS BIGINT) AS df, CAST(coalesce(sum(m.cf), 0) AS BIGINT) AS cf
          FROM qtf q LEFT JOIN matched m ON m.term = q.term GROUP BY q.term, q.qtf),
raw AS (SELECT *, CASE WHEN df = 0 THEN 'inf'::DOUBLE ELSE (1 + log10(qtf)) * log10((SELECT n FROM totals)::DOUBLE / df) END AS r FROM known),
normed AS (SELECT *, (SELECT CASE WHEN bool_or(isinf(r)) THEN 'inf'::DOUBLE ELSE sqrt(sum(r * r ORDER BY term)) END FROM raw) AS norm FROM raw),
weighed AS (SELECT *, CASE WHEN norm = 0 OR (isinf(norm) AND isinf(r)) THEN 'nan'::DOUBLE ELSE r / norm END AS w FROM normed),
hits AS (SELECT term, review_id, CAST(sum(tf) AS BIGINT) AS tf FROM matched JOIN postings USING (token) GROUP BY term, review_id)
"""
    )


def _vsm(query) -> str:
    return BASE + _weights(query) + ", ranked AS (SELECT review_id, sum((1 + log10(tf)) * w ORDER BY term) AS rank FROM hits JOIN weighed USING (term) GROUP BY review_id)"


def _lm(query, lam: float) -> str:
    return (
        BASE
        + _weights(query)
        + f""", ranked AS (
  SELECT c.review_id, product(pow({lam} * coalesce(h.tf, 0) / l.length + {1 - lam} * w.cf / (SELECT t FROM totals)::DOUBLE, w.qtf) ORDER BY w.term) AS rank
  FROM (SELECT DISTINCT review_id FROM hits) c CROSS JOIN weighed w JOIN lengths l ON l.review_id = c.review_id
  LEFT JOIN hits h ON h.review_id = c.review_id AND h.term = w.term GROUP BY c.review_id)"""
    )


_ROUND = " SELECT review_id, round(rank, 9) AS rank FROM ranked"
_LOG = " SELECT review_id, CASE WHEN rank > 0 THEN round(log10(rank), 9) END AS log_rank FROM ranked"
_CODED = "CASE WHEN gap < 64 THEN 1 WHEN gap < 16384 THEN 2 WHEN gap < 4194304 THEN 3 ELSE 4 END"
_PRODUCTS = (
    _vsm(q.PRODUCT_QUERY)
    + """, blended AS (SELECT v.product_id, avg(0.8 * rank * score / 5 + 0.2 * (CASE WHEN help_den = 0 THEN 0.5 ELSE help_num::DOUBLE / help_den END) * rank) AS rank
  FROM ranked JOIN reviews v USING (review_id) GROUP BY v.product_id) SELECT product_id, round(rank, 9) AS rank FROM blended"""
)


def _top(sql: str, key: str, k: int, of: str = "ranked") -> str:
    return f"{sql} ORDER BY {of}.rank DESC NULLS LAST, {key} LIMIT {k}"


ORACLE = {
    "read_dump_reviews": BASE + "SELECT review_id, product_id, help_num, help_den, score, md5(regexp_replace(' ' || text, '\\n+$', '')) AS text_md5 FROM reviews",
    "posting_codes": BASE + f"SELECT token, review_id, lpad(printf('%x', gap::BIGINT + (n - 1) * (1::BIGINT << (8 * n - 2))), 2 * n, '0') AS code, gap::BIGINT AS gap FROM (SELECT *, {_CODED} AS n FROM gaps)",
    "front_decoding": BASE + "SELECT token_id, token FROM numbered",
    "stored_permuterm_expand": BASE + _terms(q.PATTERNS) + " SELECT term, token, df, cf FROM matched",
    "stored_bigram_expand": BASE + _terms(q.PATTERNS) + " SELECT term, token, df, cf FROM matched",
    "stored_frequency": BASE + _terms(q.WILD + q.TERMS) + " SELECT term, CAST(coalesce(sum(df), 0) AS BIGINT) AS df, CAST(coalesce(sum(cf), 0) AS BIGINT) AS cf FROM terms LEFT JOIN matched USING (term) GROUP BY term",
    "stored_reviews_with": _reviews_with(q.WILD),
    "vocabulary": BASE + "SELECT token FROM lexicon",
    "parse_reviews": BASE + "SELECT review_id, product_id, help_num, help_den, score, md5(' ' || text) AS text_md5 FROM reviews",
    "tokenize": BASE + "SELECT review_id, unnest(range(1, len(words) + 1)) AS position, unnest(words) AS token FROM split",
    "term_frequencies": BASE + "SELECT token, review_id, tf FROM postings",
    "review_length": BASE + "SELECT review_id, length FROM lengths",
    "token_ids": BASE + "SELECT token_id, token FROM numbered",
    "product_ids": BASE + "SELECT CAST(row_number() OVER (ORDER BY product_id) - 1 AS INTEGER) AS product_idx, product_id FROM (SELECT DISTINCT product_id FROM reviews)",
    "lexicon_stats": BASE + "SELECT token, df, cf FROM lexicon",
    "posting_gaps": BASE + "SELECT token, review_id, tf, gap FROM gaps",
    "posting_decode": BASE + "SELECT token, review_id, tf FROM postings",
    "product_postings": BASE + "SELECT product_id, review_id, CAST(review_id - lag(review_id, 1, 0) OVER (PARTITION BY product_id ORDER BY review_id) AS INTEGER) AS gap FROM reviews",
    "product_counts": BASE + "SELECT product_id, count(*) AS n_reviews FROM reviews GROUP BY product_id",
    "posting_bytes": BASE + "SELECT token, CAST(sum(CASE WHEN gap < 64 THEN 1 WHEN gap < 16384 THEN 2 WHEN gap < 4194304 THEN 3 ELSE 4 END) AS BIGINT) AS gap_bytes, CAST(sum(CASE WHEN tf < 64 THEN 1 WHEN tf < 16384 THEN 2 WHEN tf < 4194304 THEN 3 ELSE 4 END) AS BIGINT) AS tf_bytes FROM gaps GROUP BY token",
    "front_coding_prefix": BASE + """, paired AS (SELECT token_id, token, lag(token) OVER (PARTITION BY token_id // 10 ORDER BY token_id) AS before FROM numbered),
common AS (SELECT token_id, token, CAST(coalesce(len(list_filter(range(1, least(length(token), length(before)) + 1), lambda i: starts_with(token, before[1:i]))), 0) AS INTEGER) AS prefix FROM paired)
SELECT token_id, token, prefix, substring(token, prefix + 1) AS suffix FROM common""",
    "bigram_index": BASE + "SELECT bigram, token FROM bigrams",
    "bigram_ids": BASE + "SELECT bigram, CAST(37 * (instr('$0123456789abcdefghijklmnopqrstuvwxyz', bigram[1]) - 1) + instr('$0123456789abcdefghijklmnopqrstuvwxyz', bigram[2]) - 1 AS INTEGER) AS bigram_id, count(*) AS n_tokens FROM bigrams GROUP BY bigram",
    "permuterm_index": BASE + "SELECT substring('$' || token || '$' || token, i, length(token) + 1) AS rotation, token, CAST(i AS INTEGER) AS place FROM (SELECT token, unnest(range(1, length(token) + 2)) AS i FROM lexicon)",
    "review_attributes": BASE + f", asked(id) AS (VALUES {_list(q.IDS)}) SELECT CAST(id AS INTEGER) AS review_id, product_id, CAST(coalesce(score, -1) AS INTEGER) AS score, CAST(coalesce(help_num, -1) AS INTEGER) AS help_num, CAST(coalesce(help_den, -1) AS INTEGER) AS help_den, CAST(coalesce(length, -1) AS INTEGER) AS length FROM asked LEFT JOIN reviews r ON r.review_id = id LEFT JOIN lengths l ON l.review_id = id",
    "token_frequency": _frequency(q.TERMS, "df"),
    "token_collection_frequency": _frequency(q.TERMS, "cf"),
    "wildcard_frequency": _frequency(q.WILD, "df"),
    "wildcard_collection_frequency": _frequency(q.WILD, "cf"),
    "reviews_with_token": _reviews_with(q.TERMS),
    "reviews_with_wildcard": _reviews_with(q.WILD),
    "corpus_stats": BASE + "SELECT n AS n_reviews, CAST(t AS BIGINT) AS n_tokens FROM totals",
    "product_reviews": BASE + f"SELECT product_id, review_id FROM reviews WHERE product_id IN (SELECT * FROM (VALUES {_list(q.PRODUCTS)}))",
    "wildcard_expand": _expand(q.PATTERNS),
    "wildcard_permuterm": _expand(q.PATTERNS),
    "wildcard_bigram": _expand(q.PATTERNS),
    "wildcard_bigram_short": _expand(q.SHORT),
    "query_terms": "SELECT term, count(*) AS qtf FROM (SELECT lower(x) AS term FROM (VALUES " + ", ".join(f"('{t}')" for t in (*q.VSM_WILD, "The", "it''s", "")) + ") v(x)) GROUP BY term",
    "query_vector": BASE + _weights(q.VSM_WILD) + " SELECT term, round(w, 9) AS weight FROM weighed",
    "vsm_scores": _vsm(q.VSM_WILD) + _ROUND,
    "vsm_topk": _top(_vsm(q.VSM) + _ROUND, "review_id", 10),
    "vsm_wildcard_topk": _top(_vsm(q.VSM_WILD) + _ROUND, "review_id", 20),
    "vsm_unknown_term": _top(_vsm(q.UNKNOWN) + _ROUND, "review_id", 20),
    "lm_scores": _lm(q.LM, q.LAMBDA) + _LOG,
    "lm_topk": _top(_lm(q.LM, q.LAMBDA) + _LOG, "review_id", 10),
    "lm_wildcard_topk": _top(_lm(q.LM_WILD, q.LAMBDA) + _LOG, "review_id", 20),
    "lm_unknown_term": _top(_lm(q.UNKNOWN, q.LAMBDA) + _LOG, "review_id", 20),
    "product_scores": _PRODUCTS,
    "product_topk": _top(_PRODUCTS, "product_id", 5, "blended"),
}
ORACLE |= {
    "stored_attributes": ORACLE["review_attributes"],
    "stored_product_reviews": ORACLE["product_reviews"],
    "stored_vsm_topk": ORACLE["vsm_wildcard_topk"],
    "stored_lm_topk": ORACLE["lm_wildcard_topk"],
    "stored_product_topk": ORACLE["product_topk"],
    "search_as_typed": ORACLE["vsm_wildcard_topk"],
}
