"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embdedup, lm, mixing, packing, pii, simhash, tokencount, topk, toxicity, urlfilter
from .common import id_remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), id_remainder("doc_id", 7) == 2)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).drop("trust", "distrust")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.withColumns({c: F.round(c, 6) for c in ("weight", "probability")})


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_embedding_dedup, op3_toxicity, op4_token_counts, op5_url_filter, op6_simhash_dedup, op7_mixing, op8_pii, op9_exact_topk, op10_best_fit_packing)}
_FINITE = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_WORDS = "CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS BIGINT)"
_TOPIC = """CASE WHEN contains(t, '@') THEN 'contact' WHEN contains(t, 'icense') OR contains(t, 'opyright') THEN 'legal'
  WHEN contains(t, 'token = ') OR contains(t, '{') OR contains(t, '://') THEN 'technical' WHEN contains(t, '|') THEN 'tabular' ELSE 'prose' END"""


def _raked(margin: str, of: str) -> str:
    return f"(SELECT * REPLACE (w * goal_{margin} / sum(mass * w) OVER (PARTITION BY {margin}) AS w) FROM {of})"


_FITS = sorted(urlfilter.RULES, key=lambda r: -len(r[1] + r[2]))
_RULED = lambda value: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(v, h, p)}'" for v, h, p in _FITS) + " END"
_LOWER = f"'{urlfilter.UPPER}', '{urlfilter.LOWER}'"
_LINK = urlfilter.LINK.replace("'", "''")


def _walk(kind: str, src: str, dst: str, verdict: str) -> str:
    """CTEs rank_<kind>(host, rank): 80 rounds of personalised PageRank."""
    return f"""seeds_{kind} AS (SELECT host, count(*)::DOUBLE / (SELECT count(*) FROM judged WHERE host <> '' AND ruled IS NOT NULL) AS s FROM judged WHERE host <> '' AND ruled = '{verdict}' GROUP BY host),
steps_{kind} AS (SELECT {src} AS host, {dst} AS dst, w / sum(w) OVER (PARTITION BY {src}) AS p FROM edges),
walk_{kind} AS (SELECT 0 AS n, host, s AS rank FROM seeds_{kind} UNION ALL
  SELECT n, host, sum(x) AS rank FROM (
    SELECT n + 1 AS n, t.dst AS host, {urlfilter.DAMPING} * r.rank * t.p AS x FROM walk_{kind} r JOIN steps_{kind} t ON t.host = r.host WHERE n < 80
    UNION ALL SELECT r.n + 1, s.host, s.s / (SELECT sum(s) FROM seeds_{kind}) * r.rank * (CASE WHEN t.host IS NULL THEN 1 ELSE 1 - {urlfilter.DAMPING} END)
    FROM walk_{kind} r LEFT JOIN (SELECT DISTINCT host FROM steps_{kind}) t ON t.host = r.host CROSS JOIN seeds_{kind} s WHERE n < 80) GROUP BY n, host),
rank_{kind} AS (SELECT host, rank FROM walk_{kind} WHERE n = 80)"""


#: The other operators train models, hash or tokenise beyond SQL; the tests hold them against brute force.
ORACLE: dict[str, str] = {
    "op2_embedding_dedup": f"""
WITH RECURSIVE finite AS ({_FINITE}),
usable AS (SELECT * FROM finite WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
          ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a), degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, root AS component_id, vec_id = root AS kept
FROM embeddings v JOIN roots r ON r.a = v.vec_id LEFT JOIN degrees d ON d.a = v.vec_id""",
    "op5_url_filter": f"""
WITH RECURSIVE parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), {_LOWER}) AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path, regexp_extract_all(coalesce(html, ''), '{_LINK}', 1) AS links FROM pages),
judged AS (SELECT page_id, host, path, links, {_RULED(lambda v, h, p: h + p)} AS rule, {_RULED(lambda v, h, p: v)} AS ruled FROM parts),
linked AS (SELECT host, translate(unnest(links), {_LOWER}) AS dst FROM judged WHERE host <> ''),
edges AS (SELECT host AS src, dst, count(*)::DOUBLE AS w FROM linked WHERE host <> dst GROUP BY host, dst),
{_walk("trust", "src", "dst", "allow")},
{_walk("distrust", "dst", "src", "block")}
SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN coalesce(d.rank, 0) > {urlfilter.RATIO * (1 + urlfilter.MARGIN)} * coalesce(t.rank, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN rank_trust t ON t.host = j.host LEFT JOIN rank_distrust d ON d.host = j.host""",
    "op7_mixing": f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS language, {_WORDS} AS n_tokens, coalesce(text, '') AS t FROM documents),
marked AS (SELECT * EXCLUDE (t), {_TOPIC} AS topic, CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), '?' || md5(t)) || ':{mixing.SEED}')[1:13] AS BIGINT) / 4503599627370496.0::DOUBLE AS chance FROM docs),
cells AS (SELECT source, language, topic, sum(n_tokens)::DOUBLE AS mass FROM marked GROUP BY ALL HAVING sum(n_tokens) > 0),
all_mass AS (SELECT sum(mass) AS total FROM cells),
{", ".join(f"goals_{m} AS (SELECT {m}, pow(sum(mass), {mixing.POWER}) AS g FROM cells GROUP BY {m}), shares_{m} AS (SELECT {m}, g / (SELECT sum(g) FROM goals_{m}) AS goal_{m} FROM goals_{m})" for m in mixing.MARGINS)},
start AS (SELECT *, 1 / (SELECT total FROM all_mass) AS w FROM cells JOIN shares_source USING (source) JOIN shares_language USING (language) JOIN shares_topic USING (topic)),
raked AS (SELECT 0 AS n, * FROM start UNION ALL SELECT n + 1 AS n, * EXCLUDE (n) FROM {_raked("topic", _raked("language", _raked("source", "raked")))} WHERE n < {mixing.ROUNDS}),
last AS (SELECT source, language, topic, mass, w * (SELECT total FROM all_mass) AS weight FROM raked WHERE n = {mixing.ROUNDS}),
ordered AS (SELECT *, coalesce(sum(mass) OVER before, 0) AS whole, sum(mass * weight) OVER rest AS open FROM last
            WINDOW before AS (ORDER BY weight DESC, source, language, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), rest AS (ORDER BY weight DESC, source, language, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
factor AS (SELECT ({mixing.KEEP} * (SELECT total FROM all_mass) - whole) / open AS r FROM ordered
           WHERE ({mixing.KEEP} * (SELECT total FROM all_mass) - whole) / open * weight <= 1 ORDER BY weight DESC, source, language, topic LIMIT 1),
final AS (SELECT source, language, topic, weight, least(1.0::DOUBLE, (SELECT r FROM factor) * weight) AS probability FROM last)
SELECT doc_id, source, language, topic, n_tokens, round(coalesce(weight, 1.0::DOUBLE), 6) AS weight, round(coalesce(probability, 1.0::DOUBLE), 6) AS probability, chance < coalesce(probability, 1.0::DOUBLE) AS kept
FROM marked LEFT JOIN final USING (source, language, topic)""",
    "op9_exact_topk": f"""
WITH finite AS ({_FINITE}), whole AS (SELECT vec_id, list_transform(e, lambda x: floor(256 * x)) AS e FROM finite WHERE vec_id IS NOT NULL),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
           FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
}
