"""Catalog snapshots, differences, identities. documents stand for files: two snapshots are fixed predicates over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions import paths
from ledgerlake.operators import changes, matching

from .registry import query, table

FILE_SQL = """
WITH f AS (SELECT doc_id, concat(source, '/', lang, '/doc', doc_id, '.txt') AS path_key, n_chars AS size, sha256(text) AS sha256, source FROM documents),
o AS (SELECT path_key, size, '1' AS modified, CASE WHEN doc_id % 17 = 0 THEN 'missing' ELSE 'present' END AS status, sha256, source FROM f WHERE doc_id % 10 <> 3),
n AS (SELECT path_key, size + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS size, '1' AS modified, sha256, source FROM f WHERE doc_id % 10 <> 7),
d AS (SELECT coalesce(o.path_key, n.path_key) AS path_key, o.size AS before_size, n.size AS after_size, coalesce(o.source, n.source) AS source,
  CASE WHEN o.path_key IS NULL THEN 'NEW' WHEN n.path_key IS NOT NULL AND o.status = 'missing' THEN 'REAPPEARED' WHEN n.path_key IS NULL AND o.status = 'missing' THEN 'STILL_MISSING'
       WHEN n.path_key IS NULL THEN 'MISSING' WHEN o.size = n.size THEN 'UNCHANGED' ELSE 'CHANGED' END AS change_type
  FROM o FULL JOIN n ON o.path_key = n.path_key)
"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat("source", F.lit("/"), "lang", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf, "documents").select("doc_id", key.alias("path_key"), F.col("n_chars").alias("size"), F.lit("1").alias("modified"), F.sha2("text", 256).alias("sha256"), "source")


def old_files(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).where("doc_id % 10 <> 3").withColumn("status", F.when(F.col("doc_id") % 17 == 0, "missing").otherwise("present"))


def new_files(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).where("doc_id % 10 <> 7").withColumn("size", F.col("size") + F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0))


@query(FILE_SQL + "SELECT path_key, change_type, before_size, after_size FROM d")
def catalog_diff(spark, sf):
    return changes.diff(old_files(spark, sf), new_files(spark, sf)).select("path_key", "change_type", "before_size", "after_size")


@query(FILE_SQL + """SELECT count(*) FILTER (change_type IN ('NEW', 'REAPPEARED')) AS new, count(*) FILTER (change_type = 'REAPPEARED') AS reappeared,
count(*) FILTER (change_type = 'CHANGED') AS changed, count(*) FILTER (change_type = 'MISSING') AS missing, count(*) FILTER (change_type = 'UNCHANGED') AS unchanged FROM d""")
def catalog_diff_counts(spark, sf):
    return changes.diff_counts(changes.diff(old_files(spark, sf), new_files(spark, sf)))


@query(FILE_SQL + """, a AS (SELECT source, sum(size) AS s, count(*) AS c FROM o GROUP BY 1), b AS (SELECT source, sum(size) AS s, count(*) AS c FROM n GROUP BY 1)
SELECT coalesce(a.source, b.source) AS source, CASE WHEN a.source IS NULL THEN 'AGGREGATE_CREATED' WHEN b.source IS NULL THEN 'AGGREGATE_REMOVED'
 WHEN coalesce(b.s, 0) >= coalesce(a.s, 0) THEN 'AGGREGATE_SIZE_GROWTH' ELSE 'AGGREGATE_SIZE_SHRINK' END AS event_type, CAST(coalesce(b.s, 0) - coalesce(a.s, 0) AS BIGINT) AS size_delta
FROM a FULL JOIN b ON a.source = b.source WHERE a.source IS NULL OR b.source IS NULL OR a.s <> b.s OR a.c <> b.c""")
def aggregate_diff(spark, sf):
    sums = lambda d: d.groupBy("source").agg(F.sum("size").alias("total_size"), F.count("*").alias("file_count"))
    return changes.aggregate_diff(sums(old_files(spark, sf)), sums(new_files(spark, sf)), "source")


# Sizes in these tables are small: a unit of 1 MiB a character brings the tiers of change events into play.
@query(FILE_SQL + """, s AS (SELECT path_key, change_type, coalesce(before_size, 0) * 1048576 AS b, coalesce(after_size, 0) * 1048576 AS a FROM d)
SELECT path_key, 'FILE_CREATED' AS event_type, a AS size_delta FROM s WHERE change_type = 'NEW'
UNION ALL SELECT path_key, 'LARGE_ASSET_CREATED', a FROM s WHERE change_type = 'NEW' AND a >= 1073741824
UNION ALL SELECT path_key, 'FILE_REAPPEARED', a FROM s WHERE change_type = 'REAPPEARED'
UNION ALL SELECT path_key, 'FILE_CHANGED', a - b FROM s WHERE change_type = 'CHANGED'
UNION ALL SELECT path_key, CASE WHEN a > b THEN 'FILE_SIZE_GROWTH' ELSE 'FILE_SIZE_SHRINK' END, a - b FROM s WHERE change_type = 'CHANGED' AND (abs(a - b) >= 67108864 OR abs(a - b) * 4 >= greatest(1, b))
UNION ALL SELECT path_key, 'FILE_MISSING', -b FROM s WHERE change_type = 'MISSING'
UNION ALL SELECT path_key, 'LARGE_ASSET_REMOVED', -b FROM s WHERE change_type = 'MISSING' AND b >= 1073741824""")
def change_events_exploded(spark, sf):
    d = changes.diff(old_files(spark, sf), new_files(spark, sf))
    d = d.withColumns({"before_size": F.col("before_size") * (1 << 20), "after_size": F.col("after_size") * (1 << 20), "volatile": F.lit(False), "model_role": F.lit(False)})
    return changes.change_events(d)


@query("""WITH p AS (SELECT page_id, url, length(html) AS n FROM pages),
c AS (SELECT n, CASE
 WHEN regexp_matches(url, '(?i)(?:^|[\\\\/]).+\\.(?:wal|shm|journal)$') THEN 'database_wal'
 WHEN regexp_matches(url, '(?i)(?:^|[\\\\/])(?:~\\$|\\.~lock\\.|[^\\\\/]+\\.(?:lock|lck))') THEN 'lock_file'
 WHEN regexp_matches(url, '(?i)(?:^|[\\\\/])(?:logs?|runtime|sessions?)(?:[\\\\/]|$)|\\.(?:log|tmp)$') THEN 'runtime_log'
 WHEN regexp_matches(url, '(?i)(?:chrome|edge|firefox|browser).*(?:cache|history|cookies|session)') THEN 'browser_state'
 WHEN regexp_matches(url, '(?i)(?:tencent|wechat|weixin|qq).*(?:wal|shm|log|cache|temp)') THEN 'communication_runtime'
 WHEN regexp_matches(url, '(?i)(?:[\\\\/])\\.codex(?:[\\\\/]).*(?:sessions?|logs?|tmp)(?:[\\\\/]|$)') THEN 'codex_runtime'
 WHEN regexp_matches(url, '(?i)(?:baidunetdisk|onedrive|dropbox).*(?:metadata|cache|sync|log)') THEN 'cloud_metadata' END AS volatile_class FROM
 (SELECT n, CASE page_id % 6 WHEN 0 THEN concat(url, '.wal') WHEN 1 THEN concat(url, '/logs/x') WHEN 2 THEN concat('dropbox/', url, '.sync') WHEN 3 THEN concat(url, '/.lock') ELSE url END AS url FROM p))
SELECT volatile_class, count(*) AS aggregate_count, CAST(sum(n) AS BIGINT) AS size_delta FROM c WHERE volatile_class IS NOT NULL GROUP BY 1""")
def volatile_collapse(spark, sf):
    p = table(spark, sf, "pages")
    k, u = F.col("page_id") % 6, F.col("url")
    url = F.when(k == 0, F.concat(u, F.lit(".wal"))).when(k == 1, F.concat(u, F.lit("/logs/x"))).when(k == 2, F.concat(F.lit("dropbox/"), u, F.lit(".sync"))).when(k == 3, F.concat(u, F.lit("/.lock"))).otherwise(u)
    p = p.select(paths.volatile_class(url).alias("volatile_class"), F.lit(0).alias("before_size"), F.length("html").alias("after_size"))
    return changes.collapse_volatile(p)


CONTENT_SQL = FILE_SQL + """, gone AS (SELECT path_key, size, sha256 FROM o WHERE status = 'present' AND path_key NOT IN (SELECT path_key FROM n)),
come AS (SELECT n.path_key, f.size, n.sha256 FROM n JOIN f USING (path_key) WHERE n.path_key NOT IN (SELECT path_key FROM o WHERE status = 'present')),
here AS (SELECT o.path_key, o.size, o.sha256 FROM o JOIN n USING (path_key) WHERE o.status = 'present')
"""


def contents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Missing, arrived and still present rows, by content."""
    old, new = old_files(spark, sf), files(spark, sf).where("doc_id % 10 <> 7")
    present = old.where("status = 'present'")
    cut = lambda d: d.select("path_key", "size", "sha256")
    return cut(present.join(new.select("path_key"), "path_key", "left_anti")), cut(new.join(present.select("path_key"), "path_key", "left_anti")), cut(present.join(new.select("path_key"), "path_key", "left_semi"))


@query(CONTENT_SQL + """SELECT c.path_key AS target_path_key, min(h.path_key) AS source_path_key FROM come c JOIN here h ON c.size = h.size AND c.sha256 = h.sha256 AND c.path_key <> h.path_key GROUP BY 1""")
def copy_candidates(spark, sf):
    _, come, here = contents(spark, sf)
    return changes.copy_candidates(come, here)


@query(CONTENT_SQL + """, g1 AS (SELECT size, sha256, min(path_key) AS p FROM gone GROUP BY ALL HAVING count(*) = 1), c1 AS (SELECT size, sha256, min(path_key) AS p FROM come GROUP BY ALL HAVING count(*) = 1)
SELECT g1.p AS source_path_key, c1.p AS target_path_key, CASE WHEN regexp_replace(g1.p, '/?[^/]*$', '') = regexp_replace(c1.p, '/?[^/]*$', '') THEN 'RENAMED' ELSE 'MOVED' END AS event_type FROM g1 JOIN c1 USING (size, sha256)""")
def exact_moves_unique_key(spark, sf):
    gone, come, _ = contents(spark, sf)
    return changes.exact_moves(gone, come)


@query(CONTENT_SQL + """SELECT path_key, CASE WHEN EXISTS (SELECT 1 FROM here h WHERE h.size = g.size AND h.sha256 = g.sha256) THEN 'content_copy_verified'
 WHEN EXISTS (SELECT 1 FROM here h WHERE h.size = g.size AND h.sha256[:2] = g.sha256[:2]) THEN 'content_copy_candidate' ELSE 'unresolved_missing' END AS resolution FROM gone g""")
def missing_survivors(spark, sf):
    gone, _, here = contents(spark, sf)
    sample = lambda d: d.withColumn("sample", F.substring("sha256", 1, 2))
    return changes.survivors(sample(gone), sample(here))


@query()
def identity_transitions(spark, sf):
    """Greedy identity over all methods, weak candidates included: order decides, so SQL has no counterpart."""
    gone, come, here = contents(spark, sf)
    side = lambda d, s: d.withColumns({"side": F.lit(s), "native_id": F.lit(None).cast("string"), "sample": F.substring("sha256", 1, 8), "rank": F.col("path_key")})
    return changes.correlate_identities(side(gone, "missing").unionByName(side(come, "arrival")).unionByName(side(here, "present")))


@query("""SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN d.lang ELSE concat('quality', l.quality) END AS role, l.quality IS NOT NULL AS explicit_user, CASE WHEN l.quality IS NULL THEN CAST(0.45 AS DOUBLE) ELSE 1.0 END AS confidence
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.toxic = 0""")
def assertion_override(spark, sf):
    inferred = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("role"), F.lit(0.45).alias("confidence"))
    said = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("quality"), F.col("quality").cast("string")).alias("value"), (F.col("toxic") == 0).alias("active"), F.lit(1).alias("updated_at"))
    return changes.apply_assertions(inferred, said, "doc_id", "role")


@query("""SELECT sha256(text) AS sha256, doc_id, count(*) OVER (PARTITION BY sha256(text)) AS n, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents QUALIFY n > 1""")
def duplicate_candidates(spark, sf):
    return matching.duplicates(files(spark, sf), ["sha256"], "doc_id")


@query("""WITH f AS (SELECT doc_id, n_chars AS size, sha256(text) AS sha256 FROM documents), g AS (SELECT *, count(*) OVER (PARTITION BY size, sha256) AS group_size FROM f)
SELECT doc_id, group_size, first_value(doc_id) OVER (PARTITION BY size, sha256 ORDER BY doc_id DESC) AS canonical FROM g WHERE group_size > 1""")
def staged_duplicates(spark, sf):
    f = files(spark, sf).withColumn("sample", F.substring("sha256", 1, 16))
    return matching.staged_duplicates(f, "doc_id", [F.desc("doc_id")]).select("doc_id", "group_size", "canonical")


@query("""WITH p AS (SELECT p_partkey, regexp_replace(lower(p_name), '[0-9]+', '') AS family, p_retailprice FROM part)
SELECT p_partkey, family, count(*) OVER (PARTITION BY family) AS family_size, row_number() OVER (PARTITION BY family ORDER BY p_retailprice DESC, p_partkey) AS family_rank,
 CASE WHEN row_number() OVER (PARTITION BY family ORDER BY p_retailprice DESC, p_partkey) > 1 THEN first_value(p_partkey) OVER (PARTITION BY family ORDER BY p_retailprice DESC, p_partkey) END AS superseded_by
FROM p QUALIFY count(*) OVER (PARTITION BY family) > 1""")
def version_families(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.regexp_replace(F.lower("p_name"), "[0-9]+", "").alias("family"), "p_retailprice")
    return matching.version_families(p, "family", [F.desc("p_retailprice"), F.col("p_partkey")], "p_partkey").drop("p_retailprice")


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS u FROM pages)
SELECT page_id, CASE WHEN regexp_matches(lower(regexp_extract(u, '([^/]*)$', 1)), '\\.(cas\\.h5|dat\\.h5|msh\\.h5|tar\\.gz|scdocx)$') THEN regexp_extract(lower(regexp_extract(u, '([^/]*)$', 1)), '(\\.(?:cas\\.h5|dat\\.h5|msh\\.h5|tar\\.gz|scdocx))$', 1)
 ELSE regexp_extract(lower(regexp_extract(u, '([^/]*)$', 1)), '^.+(\\.[^./]+)$', 1) END AS extension FROM p""")
def extension_of_path(spark, sf):
    return table(spark, sf, "pages").select("page_id", paths.extension(F.regexp_replace("url", "^[a-z]+://", "")).alias("extension"))


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages),
r AS (SELECT DISTINCT regexp_extract(path, '^[^/]*', 0) AS root FROM p WHERE page_id % 2 = 0 UNION SELECT DISTINCT regexp_extract(path, '^[^/]*/[^/]*', 0) FROM p WHERE page_id % 3 = 0 AND contains(path, '/')),
m AS (SELECT p.page_id, arg_max(r.root, length(r.root)) AS root FROM p JOIN r ON p.path = r.root OR starts_with(p.path, concat(r.root, '/')) GROUP BY 1)
SELECT p.page_id, m.root FROM p LEFT JOIN m USING (page_id)""")
def longest_prefix_project(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))
    a = p.where("page_id % 2 = 0").select(F.regexp_extract("path", "^[^/]*", 0).alias("root"))
    b = p.where("page_id % 3 = 0 and contains(path, '/')").select(F.regexp_extract("path", "^[^/]*/[^/]*", 0).alias("root"))
    return matching.longest_prefix(p, a.union(b).distinct(), "path", "root").select("page_id", "root")


@query("""SELECT count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS common, count(*) FILTER (l.doc_id IS NULL) AS only_left, count(*) FILTER (d.doc_id IS NULL) AS only_right,
 count(*) FILTER (l.doc_id IS NULL) = 0 AND count(*) FILTER (d.doc_id IS NULL) = 0 AS equal FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 <> 0) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def set_compare_backends(spark, sf):
    return matching.compare_sets(table(spark, sf, "documents").where("doc_id % 3 <> 0"), table(spark, sf, "labels"), "doc_id")
