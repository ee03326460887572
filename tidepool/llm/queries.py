"""The registered queries of this subpackage: thin calls of its operators over whole tables."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, language_id, lattice_dedup, mixing, near_dedup, projected_search, quality, secret_scan, token_counts, url_filter
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["s"].cast("string"), s["e"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    return found.select("doc_id", *[count(k) for k in secret_scan.BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_projected_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return projected_search.nearest_inner_product(rows, rows.where(F.col("vec_id") % 20 == 0))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def bpe_digest(coded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8_mix_sources aims at: a row for each source."""
    units = mixing.units_of(table(spark, sf_dir, "documents"))
    return mixing.source_targets(units).select("source", "source_size", "n", F.round("target", 3).alias("target"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of op5_url_filter, and the verdict where a rule gives it."""
    out = url_filter.judge(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def lattice_dedup_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_lattice_dedup over embeddings with three altered copies of each: two within the threshold, one beyond it."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    copy = lambda first, share: e.select((F.col("vec_id") + first).alias("vec_id"), F.transform("e", lambda x, i: F.when(i % 2 == 0, x).otherwise(x * share)).alias("e"))
    rows = e.unionByName(copy(10**9, 0.85)).unionByName(copy(2 * 10**9, 1.15)).unionByName(copy(3 * 10**9, -0.2))
    return lattice_dedup.near_duplicates(rows, vector_col="e")


QUERIES = {f.__name__: f for f in (mix_targets, url_rules, lattice_dedup_planted, op1_token_counts, op2_near_dedup, op3_secret_scan, op4_projected_search, op5_url_filter, op6_lattice_dedup, op7_language_id, op8_mix_sources, op9_byte_bpe, op10_quality)}
_COMPONENTS = """sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM sides UNION SELECT r.a, e.b FROM reach r JOIN sides e ON e.a = r.b),
comp AS (SELECT a, min(least(a, b)) AS component_id FROM reach GROUP BY a)"""

ORACLE_SQL: dict[str, str] = {
    "op2_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
d AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
s AS (SELECT doc_id, len(sh) AS n, hash(unnest(sh)) AS x FROM d),
links AS (SELECT p.doc_id AS a, q.doc_id AS b FROM s p JOIN s q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
{_COMPONENTS}
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM d LEFT JOIN comp ON a = doc_id""",
    "mix_targets": """WITH RECURSIVE s AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS size, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s), t AS (SELECT sum(size) AS size, sum(w) AS w FROM w),
l AS (SELECT 0 AS i, 1.5 * size / w AS level FROM t
UNION ALL SELECT i + 1, (SELECT (1.5 * any_value(t.size) - coalesce(sum(2 * w.size) FILTER (WHERE 2 * w.size <= w.w * l.level), 0)) / (any_value(t.w) - coalesce(sum(w.w) FILTER (WHERE 2 * w.size <= w.w * l.level), 0)) FROM w, t) FROM l WHERE i < 12)
SELECT source, CAST(size AS BIGINT) AS source_size, n, round(least(2.0 * size, w.w * (SELECT max(level) FROM l)), 3) AS target FROM w""",
    "url_rules": """WITH p AS (SELECT page_id, coalesce(url, '') AS url, position('://' IN coalesce(url, '')) AS pos FROM pages),
r AS (SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM p),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM r),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(h, p, says) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT page_id, arg_max(rules.h || p, length(rules.h || p)) AS rule, arg_max(says, length(rules.h || p)) AS verdict FROM u JOIN rules ON (host = rules.h OR ends_with(host, '.' || rules.h)) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, host, path, rule, verdict FROM u LEFT JOIN f USING (page_id)""",
    "lattice_dedup_planted": f"""WITH RECURSIVE o AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
v AS (SELECT * FROM o UNION ALL SELECT vec_id + f, list_transform(e, lambda x, i: CASE WHEN i % 2 = 1 THEN x ELSE x * share END) FROM o, (VALUES (1000000000, 0.85), (2000000000, 1.15), (3000000000, -0.2)) c(f, share)),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id AND list_cosine_similarity(p.e, q.e) >= 0.95),
{_COMPONENTS}, n AS (SELECT a, count(*) AS n FROM sides GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept FROM v LEFT JOIN comp ON comp.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op6_lattice_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id AND list_cosine_similarity(p.e, q.e) >= 0.95),
{_COMPONENTS}, n AS (SELECT a, count(*) AS n FROM sides GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept FROM v LEFT JOIN comp ON comp.a = vec_id LEFT JOIN n ON n.a = vec_id""",
}
