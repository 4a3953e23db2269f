"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import fold
from . import causal_lm, centroids, decontam, divergence, exactdedup, langid, minhash, packing, sharding, tokenfiles, toxicity, urlfilter, wordpiece

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


SHINGLES = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
    e AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    l AS (SELECT a, b FROM p WHERE 100 * i >= 75 * (na + nb - i)),
    both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l)"""


@query(
    "op1_minhash_near_dedup",
    f"""WITH RECURSIVE {SHINGLES},
    reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a)
    SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
    FROM s JOIN (SELECT d, min(r) AS component_id FROM reach GROUP BY d) c ON c.d = s.doc_id""",
)
def op1_minhash_near_dedup(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents"))


@query("op2_language_id")
def op2_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    model = langid.learn(docs.where(fold("doc_id", 5) != 0))
    return langid.label(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def _url_sql() -> str:
    site = ", ".join(f"('{r}', '{r.partition('/')[0]}', '{'/' + r.partition('/')[2]}', '{v}')" for r, v in urlfilter.SITE_RULES)
    end = r"([^A-Za-z0-9_.%-]|$)"
    likes = {"/search?*q=": r"/search\?.*q=", ".exe|": r"\.exe$"}
    pattern = ", ".join(f"('{r}', '{likes.get(r, r.replace('^', end))}', '{v}')" for r, v in urlfilter.PATTERN_RULES)
    return rf"""WITH u AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    site(rule, h, p, v) AS (VALUES {site}), pat(rule, re, v) AS (VALUES {pattern}),
    s AS (SELECT u.*, (SELECT max({{'l': length(rule), 'v': v, 'r': rule}}) FROM site WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS s,
        (SELECT max({{'l': length(rule), 'v': v, 'r': rule}}) FROM pat WHERE regexp_matches(url, re)) AS p FROM u)
    SELECT page_id, host, path, s.r AS rule, coalesce(s.v, p.v, 'allow') AS verdict, CASE WHEN s IS NULL THEN p.r END AS pattern FROM s"""


@query("op3_url_filter", _url_sql())
def op3_url_filter(spark, sf):
    return urlfilter.judge(table(spark, sf, "pages"), urlfilter.rule_table(spark))


@query("op4_token_files")
def op4_token_files(spark, sf):
    return tokenfiles.read_documents(tokenfiles.write_tokens(table(spark, sf, "documents")))


@query(
    "op5_exact_dedup",
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
    r AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r""",
)
def op5_exact_dedup(spark, sf):
    out = exactdedup.dedup(spark, f"{sf}/documents.parquet")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query("op6_toxicity")
def op6_toxicity(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.learn(docs, labels.where(fold("doc_id", 5) != 0))
    held = fold("doc_id", 5) == 0
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses")


@query("op7_benchmark_leaks")
def op7_benchmark_leaks(spark, sf):
    return decontam.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op8_token_counts")
def op8_token_counts(spark, sf):
    return wordpiece.token_counts(table(spark, sf, "documents"))


@query("op9_language_model")
def op9_language_model(spark, sf):
    out = causal_lm.score(table(spark, sf, "documents"), fold("doc_id", 7) != 2)
    held = fold("doc_id", 7) == 2
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"))


def _cluster_sql(k: int = centroids.CENTROIDS, rounds: int = centroids.ROUNDS) -> str:
    """Plain rounds: every vector measures every centroid."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = {centroids.COMPONENTS} AND len(list_filter(embedding, lambda x: coalesce(isfinite(CAST(x AS DOUBLE)), false))) = len(embedding))""",
        "e AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v)",
        f"""f AS (SELECT v, row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id)) - 1 AS c FROM v QUALIFY c < {k})""",
        "c0 AS MATERIALIZED (SELECT c, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM f)",
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} AS (SELECT r, c, sum((x - y) * (x - y)) AS d FROM e JOIN c{n} USING (i) GROUP BY r, c)")
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, min({{'d': d, 'c': c}}) AS m FROM d{n} GROUP BY r)")
        if n < rounds:
            parts.append(f"m{n} AS (SELECT m.c AS c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN e USING (r) GROUP BY ALL)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN m.n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y FROM c{n} LEFT JOIN m{n} m USING (c, i))")
    parts.append(f"h AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return "WITH " + ",\n    ".join(parts) + f"""
    SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
        CAST(sum(m.d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN h ON h.c = m.c"""


@query("op11_centroid_clusters", _cluster_sql())
def op11_centroid_clusters(spark, sf):
    return centroids.cluster(table(spark, sf, "embeddings")).drop("second")


@query("op12_minimax_shards")
def op12_minimax_shards(spark, sf):
    return sharding.assign(table(spark, sf, "documents"))


DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    o AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
    k AS MATERIALIZED (SELECT lang, term, sum(n) AS total FROM o GROUP BY ALL HAVING sum(docs) >= 3),
    l AS (SELECT lang, count(*) AS V, sum(total) AS M FROM k GROUP BY lang),
    x AS (SELECT lang, source, term, total, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) JOIN k USING (lang) LEFT JOIN o USING (lang, source, term)),
    s AS (SELECT lang, source, sum(n) AS own FROM x GROUP BY ALL),
    p AS MATERIALIZED (SELECT lang, source, term, n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // (own + V) AS BIGINT) AS p,
        CAST(1 + (CAST(1000000000 AS HUGEINT) * (total + 1)) // (M + V) AS BIGINT) AS q FROM x JOIN s USING (lang, source) JOIN l USING (lang)),
    f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    g AS (SELECT DISTINCT lang, source FROM d),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q)
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200"""


@query("op13_source_divergence", DIVERGENCE)
def op13_source_divergence(spark, sf):
    return divergence.audit(table(spark, sf, "documents"))
