"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, lines, mixing, mtree, packing, quality, suffix_tree, suffixes, toxicity, urls


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.suffix_dedup(read(spark, sf_dir, "documents"), length=400, keep="none")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


#: The rules of the url query.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = toxicity.part_of(F.col("doc_id"), 3) == 1
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), held_out)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"), k=3, percent=90)


def op9_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = toxicity.part_of(F.col("doc_id"), 7) == 2
    return suffix_tree.score_texts(read(spark, sf_dir, "documents"), held_out)


def queries() -> dict:
    return {f.__name__: f for f in (op1_mixing, op2_packing, op3_suffixes, op4_lines, op5_quality, op6_toxicity, op7_urls, op8_jaccard, op9_mtree, op10_suffix_tree)}


#: Every repeated run of at least 50 words is a union of windows that are the shortest of 50 words from their first or to their last line.
OP4_SQL = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
r AS (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS ln FROM l),
w AS (SELECT doc_id, ln, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS i, sum(n) OVER (PARTITION BY doc_id ORDER BY ln) AS upto FROM w WHERE n > 0),
c AS (SELECT a.doc_id, a.i AS i, b.i AS e, a.ln AS s, b.ln AS t, b.upto - a.upto + a.n AS total, a.n AS first_n, b.n AS last_n
      FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 49),
m AS (SELECT doc_id, i, e, s, t FROM c WHERE total >= 50 AND (total - last_n < 50 OR total - first_n < 50)),
k AS (SELECT m.doc_id, m.i, m.s, m.t, string_agg(f.x, chr(10) ORDER BY f.i) AS body FROM m JOIN f ON m.doc_id = f.doc_id AND f.i BETWEEN m.i AND m.e GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS nth FROM k),
d AS (SELECT DISTINCT o.doc_id, r.ln FROM o JOIN r ON o.doc_id = r.doc_id AND r.ln BETWEEN o.s AND o.t WHERE nth > 1),
g AS (SELECT r.doc_id, count(*) AS n_lines, count(d.ln) AS n_removed, string_agg(r.x, chr(10) ORDER BY r.ln) FILTER (d.ln IS NULL) AS body
      FROM r LEFT JOIN d ON r.doc_id = d.doc_id AND r.ln = d.ln GROUP BY r.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM g
"""


OP7_SQL = r"""
WITH RECURSIVE p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
u AS (SELECT page_id, url, html, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS rest FROM p),
g AS (SELECT *, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM u WHERE contains(url, '://')),
l AS (SELECT *, replace(CASE WHEN regexp_matches(tag, '(?i)\brel\s*=\s*["'']?[^"''>]*\bcanonical\b') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
      WHEN regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?i)\bcontent\s*=\s*["'']?\s*\d+\s*;\s*url\s*=\s*["'']?([^"''\s>]+)', 1) END, '&amp;', '&') AS dst FROM g),
t AS (SELECT host || rest AS a, CASE WHEN contains(dst, '://') THEN dst WHEN starts_with(dst, '//') THEN 'x:' || dst WHEN starts_with(dst, '/') THEN 'x://' || host || dst
      ELSE 'x://' || host || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || dst END AS full_url FROM l WHERE dst <> ''),
e AS (SELECT a, translate(regexp_extract(full_url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(full_url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS b FROM t),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
r AS (SELECT a AS x, b AS y FROM b UNION SELECT r.x, b.b FROM r JOIN b ON r.y = b.a),
n AS (SELECT DISTINCT y, regexp_extract(y, '^[^/?#]*', 0) AS host, regexp_extract(y, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
k AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) v(h, q, v)),
f AS (SELECT n.y, arg_max(v, length(h || q)) AS v FROM n JOIN k ON (n.host = h OR ends_with(n.host, '.' || h)) AND starts_with(n.path, q) GROUP BY 1),
c AS (SELECT r.x, max(CASE WHEN f.v = 'allow' THEN 1 ELSE 0 END) AS allowed, max(CASE WHEN f.v = 'block' THEN 1 ELSE 0 END) AS blocked FROM r JOIN f ON r.y = f.y GROUP BY 1),
o AS (SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS v FROM u JOIN k ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, q) GROUP BY 1)
SELECT u.page_id, u.host, u.path, o.rule, coalesce(o.v, CASE WHEN c.allowed = 1 THEN 'allow' WHEN c.blocked = 1 THEN 'block' END, 'allow') AS verdict,
 CASE WHEN o.rule IS NOT NULL THEN 'rule' WHEN c.x IS NOT NULL THEN 'alias' ELSE 'default' END AS "by" FROM u LEFT JOIN o USING (page_id) LEFT JOIN c ON c.x = u.host || u.rest AND contains(u.url, '://')
"""

OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x)
SELECT x AS doc_id, coalesce(n.n, 0) AS n_shingles, min(y) AS component_id FROM r LEFT JOIN n ON n.doc_id = x GROUP BY ALL
"""

OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_lines": OP4_SQL, "op7_urls": OP7_SQL, "op8_jaccard": OP8_SQL, "op9_mtree": OP9_SQL}
