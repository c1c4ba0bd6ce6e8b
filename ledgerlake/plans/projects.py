"""Projects and maintenance runs. pages stand for files in folders, documents for catalog rows, orders and customers for assets and projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions import paths
from ledgerlake.operators import changes, history, maintenance, matching, projects

from .catalog import CONTENT_SQL, FILE_SQL, contents, files, new_files, old_files
from .registry import query, table
from .timelines import AS_OF, EVENT_SQL, log, rollup, rollup_sql

# The path of a page: its host, then folders.
PAGE_SQL = """
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, length(html) AS size FROM pages)
"""


def page_paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"), F.length("html").alias("size"))


ASSIGN_SQL = PAGE_SQL + """, s AS (SELECT page_id, size, concat('/', CASE page_id % 3 WHEN 0 THEN 'data/' WHEN 1 THEN 'Docs/src/' ELSE '' END, path) AS rest, CASE page_id % 5 WHEN 0 THEN 'b/c' WHEN 1 THEN 'b' WHEN 2 THEN 'a' ELSE 'x' END AS base FROM p),
f AS (SELECT page_id, size, concat(base, rest) AS path, CASE WHEN base IN ('b/c', 'b') THEN 'b' WHEN base = 'a' THEN 'a' END AS root FROM s),
d AS (SELECT *, string_split(substr(path, length(root) + 2), '/') AS parts FROM f), e AS (SELECT *, parts[1:len(parts) - 1] AS dirs FROM d),
g AS (SELECT *, list_contains(['desktop', 'downloads', 'documents', 'research', 'projects', 'project', 'data', 'results', 'output', 'figures', 'docs', 'scripts', 'src', 'tests'], lower(dirs[1])) AS gen FROM e),
h AS (SELECT *, CASE WHEN gen THEN dirs[2] ELSE dirs[1] END AS cand FROM g),
k AS (SELECT *, CASE WHEN NOT list_contains(['desktop', 'downloads', 'documents', 'research', 'projects', 'project', 'data', 'results', 'output', 'figures', 'docs', 'scripts', 'src', 'tests'], lower(cand)) THEN cand END AS project FROM h),
r AS (SELECT page_id, path, size, root, project, CASE WHEN project IS NOT NULL THEN concat('project_', substr(sha256(concat(lower(root), '|', lower(project))), 1, 16)) END AS project_id FROM k)
"""


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id")
    base = F.when(k % 5 == 0, "b/c").when(k % 5 == 1, "b").when(k % 5 == 2, "a").otherwise("x")
    rest = F.when(k % 3 == 0, "/data/").when(k % 3 == 1, "/Docs/src/").otherwise("/")
    f = page_paths(spark, sf).select("page_id", "size", F.concat(base, rest, "path").alias("path"))
    roots = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b/c")], "ord int, root string")
    return projects.assign_projects(f, roots)


@query(ASSIGN_SQL + "SELECT page_id, root, project, project_id FROM r")
def project_assignment(spark, sf):
    return assigned(spark, sf).select("page_id", "root", "project", "project_id")


@query(ASSIGN_SQL + "SELECT project_id, min(project) AS name, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_size FROM r WHERE project_id IS NOT NULL GROUP BY 1")
def project_totals(spark, sf):
    return projects.project_totals(assigned(spark, sf))


@query(PAGE_SQL + """, w AS (SELECT DISTINCT regexp_extract(path, '^[^/]*', 0) AS root, concat('b', regexp_extract(path, '^[^/]*', 0)) AS name FROM p UNION SELECT DISTINCT regexp_extract(path, '^[^/]*/[^/]*', 0), concat('a', regexp_extract(path, '^[^/]*/[^/]*', 0)) FROM p WHERE contains(path, '/') AND page_id % 2 = 0)
SELECT p.page_id, arg_min(w.root, (w.name, w.root)) AS root, min(w.name) AS name FROM p LEFT JOIN w ON p.path = w.root OR starts_with(p.path, concat(w.root, '/')) GROUP BY 1""")
def workstream_of_path(spark, sf):
    p = page_paths(spark, sf)
    a = p.select(F.regexp_extract("path", "^[^/]*", 0).alias("root")).distinct().withColumn("name", F.concat(F.lit("b"), "root"))
    b = p.where("contains(path, '/') and page_id % 2 = 0").select(F.regexp_extract("path", "^[^/]*/[^/]*", 0).alias("root")).distinct().withColumn("name", F.concat(F.lit("a"), "root"))
    return projects.first_prefix(p, a.union(b), "path", "root", "name").select("page_id", "root", "name")


@query("""SELECT f.o_orderkey AS path_key, f.o_totalprice AS size, a.c_name AS role, n.n_name AS understood_project FROM orders f LEFT JOIN customer a ON a.c_custkey = f.o_custkey AND a.c_acctbal > 0 LEFT JOIN nation n ON n.n_nationkey = a.c_nationkey AND n.n_regionkey <> 2""")
def asset_details(spark, sf):
    f = table(spark, sf, "orders").select(F.col("o_custkey").alias("path_key"), F.col("o_orderkey").alias("file"), F.col("o_totalprice").alias("size"))
    a = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("path_key"), F.col("c_name").alias("role"), F.col("c_nationkey").alias("project_id"))
    p = table(spark, sf, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("understood_project"))
    return projects.asset_details(f, a, p).select(F.col("file").alias("path_key"), "size", "role", "understood_project")


@query("""SELECT CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS bytes FROM documents WHERE doc_id % 3 <> 0 AND lang IN ('en', 'de')""")
def archive_bytes(spark, sf):
    d = table(spark, sf, "documents")
    key = F.col("doc_id").cast("string").alias("path_key")
    kind = F.when(F.col("lang") == "en", "REVIEW_SUPERSEDED").when(F.col("lang") == "de", "REVIEWXEXACT").otherwise("KEEP")
    f = d.select(key, F.when(F.col("doc_id") % 3 == 0, "missing").otherwise("present").alias("status"), F.col("n_chars").alias("size"))
    return projects.review_bytes(d.select(key, kind.alias("archive_recommendation")), f)


@query("""SELECT c.c_custkey AS project_id, c.c_name AS name, coalesce(o.s, 'UNKNOWN') AS activity_status FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS s FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey WHERE c.c_acctbal >= 0""")
def projects_with_activity(spark, sf):
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") >= 0, "understood").otherwise("heuristic").alias("status"))
    a = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("project_id")).agg(F.max("o_orderstatus").alias("activity_status"))
    return projects.with_activity(p, a).select("project_id", "name", "activity_status")


NAMED_SQL = EVENT_SQL + """, j AS (SELECT l.*, n.n_name, CASE WHEN project_id % 7 = 0 THEN NULL ELSE project_id END AS pid FROM l LEFT JOIN nation n ON n.n_nationkey = CASE WHEN project_id % 7 = 0 THEN NULL ELSE project_id END)
"""


def named(spark: SparkSession, sf: str) -> DataFrame:
    e = log(spark, sf).withColumn("project_id", F.when(F.col("project_id") % 7 != 0, F.col("project_id")))
    return projects.named_events(e, table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("project_id"), F.col("n_name").alias("name")))


@query(NAMED_SQL + "SELECT event_id, CASE WHEN pid IS NULL THEN 'Unassigned / system aggregate' ELSE coalesce(n_name, CAST(pid AS VARCHAR)) END AS project_name FROM j")
def events_with_project_names(spark, sf):
    return named(spark, sf).select("event_id", "project_name")


@query("""WITH a AS (SELECT unnest(['FRANCE', 'japan', '7', 'nowhere', 'Peru', '24']) AS value), r AS (SELECT value, n_nationkey AS id, 0 AS o FROM a JOIN nation ON value = CAST(n_nationkey AS VARCHAR) UNION ALL SELECT value, n_nationkey, 1 FROM a JOIN nation ON lower(value) = lower(n_name))
SELECT value, arg_min(id, (o, id)) AS project_id FROM r GROUP BY 1""")
def project_by_name_or_id(spark, sf):
    asked = spark.createDataFrame([(v,) for v in ("FRANCE", "japan", "7", "nowhere", "Peru", "24")], "value string")
    return projects.resolve_project(table(spark, sf, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("name")), asked)


@query(EVENT_SQL + "SELECT event_id, occurred_at, rank FROM (SELECT event_id, occurred_at, row_number() OVER (ORDER BY occurred_at DESC, event_id DESC) AS rank FROM l WHERE project_id = 7) WHERE rank <= 1000")
def project_history(spark, sf):
    e = history.in_range(log(spark, sf), project_id=7)
    return history.newest(e, 1000).select("event_id", "occurred_at", "rank")


@query("""WITH f AS (SELECT doc_id, source AS file_id, CASE WHEN doc_id % 4 = 0 THEN 'present' ELSE 'missing' END AS status FROM documents), c AS (SELECT file_id, arg_min(doc_id, (CASE status WHEN 'present' THEN 0 ELSE 1 END, doc_id)) AS doc_id FROM f GROUP BY 1)
SELECT c.file_id, c.doc_id, f.status FROM c JOIN f USING (doc_id)""")
def present_row_first(spark, sf):
    f = table(spark, sf, "documents").select("doc_id", F.col("source").alias("file_id"), F.when(F.col("doc_id") % 4 == 0, "present").otherwise("missing").alias("status"))
    return projects.prefer_present(f, "file_id", "doc_id").select("file_id", "doc_id", "status")


@query("""WITH f AS (SELECT source, lang, doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS gone FROM documents), c AS (SELECT source AS file_id, arg_min(lang, (gone, doc_id)) AS lang FROM f GROUP BY 1),
e AS (SELECT file_id, event_id, occurred_at FROM (""" + EVENT_SQL + """SELECT event_id, occurred_at, concat('src', event_id % 25) AS file_id FROM l))
SELECT file_id, lang, event_id, rank FROM (SELECT file_id, lang, event_id, row_number() OVER (PARTITION BY file_id ORDER BY occurred_at DESC, event_id DESC) AS rank FROM c JOIN e USING (file_id)) WHERE rank <= 500""")
def file_history(spark, sf):
    f = table(spark, sf, "documents").select("doc_id", "lang", F.col("source").alias("file_id"), F.when(F.col("doc_id") % 3 == 0, "missing").otherwise("present").alias("status"))
    cards = projects.prefer_present(f, "file_id", "doc_id").select("file_id", "lang")
    e = log(spark, sf).select("event_id", "occurred_at", F.concat(F.lit("src"), (F.col("event_id") % 25).cast("string")).alias("file_id"))
    return history.top_per_group(e.join(cards, "file_id"), "file_id", [F.desc("occurred_at"), F.desc("event_id")], 500).select("file_id", "lang", "event_id", "rank")


@query(FILE_SQL + "SELECT path_key, change_type FROM d ORDER BY change_type, lower(path_key), path_key")
def changes_in_order(spark, sf):
    return changes.diff(old_files(spark, sf), new_files(spark, sf)).select("path_key", "change_type").orderBy(*projects.changes_order())


ROLLUP_SQL = f"WITH r AS ({rollup_sql('true')})"


def named_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rollup(log(spark, sf), True).withColumn("project_name", F.concat(F.lit("P"), F.col("project_id").cast("string")))


@query(ROLLUP_SQL + "SELECT project_id, concat('P', project_id) AS project_name, top_score, storage_delta, row_number() OVER (ORDER BY top_score DESC, abs(storage_delta) DESC, lower(concat('P', project_id)), project_id) AS rank FROM r QUALIFY rank <= 20")
def project_changes_top(spark, sf):
    top = projects.project_changes(named_rollup(spark, sf)).limit(20)
    return history.numbered(top, [F.desc("top_score"), F.desc(F.abs("storage_delta")), F.lower("project_name"), F.col("project_id")]).select("project_id", "project_name", "top_score", "storage_delta", "rank")


@query(ROLLUP_SQL + "SELECT project_id, concat('P', project_id) AS project_name, storage_delta FROM r WHERE storage_delta <> 0 ORDER BY abs(storage_delta) DESC, project_id")
def storage_changes(spark, sf):
    return projects.storage_changes(named_rollup(spark, sf))


CAND_SQL = PAGE_SQL + """, c AS (SELECT concat(path, CASE page_id % 6 WHEN 0 THEN '/Readme.md' WHEN 1 THEN '/status.txt' WHEN 2 THEN '/archive/a.pdf' WHEN 3 THEN '/m.mph' WHEN 4 THEN '/x.stl' ELSE '/b.bin' END, CAST(page_id AS VARCHAR)) AS key0, page_id, size, path FROM p),
f AS (SELECT page_id, size, concat(path, '/', CAST(page_id AS VARCHAR), CASE page_id % 6 WHEN 0 THEN '/Readme.md' WHEN 1 THEN '/status.txt' WHEN 2 THEN '/archive/a.pdf' WHEN 3 THEN '/m.mph' WHEN 4 THEN '/x.stl' ELSE '/b.bin' END) AS path_key,
 CASE page_id % 6 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.pdf' WHEN 3 THEN '.mph' WHEN 4 THEN '.stl' ELSE '.bin' END AS extension, page_id % 11 = 0 AS is_communication FROM p)
"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id") % 6
    end = F.when(k == 0, "/Readme.md").when(k == 1, "/status.txt").when(k == 2, "/archive/a.pdf").when(k == 3, "/m.mph").when(k == 4, "/x.stl").otherwise("/b.bin")
    p = page_paths(spark, sf).select("page_id", "size", F.concat("path", F.lit("/"), F.col("page_id").cast("string"), end).alias("path_key"), (F.col("page_id") % 11 == 0).alias("is_communication"))
    return p.withColumn("extension", paths.extension(F.col("path_key")))


HIGH_VALUE = [".md", ".txt", ".pdf", ".stl"]


@query(CAND_SQL + "SELECT path_key FROM f ORDER BY NOT is_communication, extension NOT IN ('.md', '.txt', '.pdf', '.stl'), size, path_key LIMIT 100")
def fingerprint_candidates(spark, sf):
    return projects.fingerprint_candidates(candidates(spark, sf), HIGH_VALUE, 100).select("path_key")


@query(CAND_SQL + """, n AS (SELECT *, lower(regexp_extract(path_key, '([^/]*)$', 1)) AS name FROM f) SELECT path_key FROM n WHERE extension IN ('.md', '.txt', '.pdf', '.mph') OR starts_with(name, 'readme')
ORDER BY NOT starts_with(name, 'readme'), length(path_key) - length(replace(path_key, '/', '')), NOT regexp_matches(name, 'manifest|index|status|report|deliverable|decision'), extension NOT IN ('.md', '.txt', '.json', '.yaml', '.yml'), extension NOT IN ('.docx', '.pptx', '.pdf'), regexp_matches(lower(path_key), 'archive|histor'), size, path_key LIMIT 400""")
def inspection_candidates(spark, sf):
    return projects.inspection_candidates(candidates(spark, sf), [".md", ".txt", ".pdf", ".mph"], 400).select("path_key")


@query(CAND_SQL + "SELECT path_key FROM f ORDER BY extension NOT IN ('.mph', '.pdf'), size DESC, path_key LIMIT 1200")
def hash_candidates(spark, sf):
    return projects.hash_candidates(candidates(spark, sf), [".mph", ".pdf"], 1200).select("path_key")


@query(CAND_SQL + """, a AS (SELECT path_key AS path, CASE page_id % 4 WHEN 0 THEN 'CANONICAL' WHEN 1 THEN 'ACTIVE' WHEN 2 THEN 'PRIMARY' ELSE 'REFERENCE' END AS authority_level, CASE page_id % 5 WHEN 0 THEN 'GATE_LOCAL' WHEN 1 THEN 'WORKSTREAM_LOCAL' WHEN 2 THEN 'PROJECT_WIDE' ELSE 'FILE_LOCAL' END AS authority_scope, (page_id % 10) / 10.0 AS confidence FROM f),
b AS (SELECT path, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN authority_scope IN ('GATE_LOCAL', 'WORKSTREAM_LOCAL') THEN 'scoped_authorities' ELSE 'authorities' END AS list FROM a WHERE authority_level <> 'REFERENCE')
SELECT path, confidence, list FROM b QUALIFY row_number() OVER (PARTITION BY list ORDER BY confidence DESC, lower(path), path) <= 100""")
def authority_lists(spark, sf):
    k = F.col("page_id")
    pick = lambda n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (k % n + 1).cast("int"))
    a = candidates(spark, sf).select(F.col("path_key").alias("path"), pick(4, "CANONICAL", "ACTIVE", "PRIMARY", "REFERENCE").alias("authority_level"), pick(5, "GATE_LOCAL", "WORKSTREAM_LOCAL", "PROJECT_WIDE", "FILE_LOCAL", "FILE_LOCAL").alias("authority_scope"), ((k % 10) / 10.0).alias("confidence"))
    return projects.authority_lists(a).select("path", "confidence", "list")


@query("SELECT page_id AS path, length(html) / 1000.0 AS seconds FROM pages ORDER BY 2 DESC, 1 LIMIT 10")
def slowest_inspections(spark, sf):
    return projects.slowest(table(spark, sf, "pages").select(F.col("page_id").alias("path"), (F.length("html") / 1000.0).alias("seconds")))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS edge_id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS edge_id FROM orders WHERE o_orderstatus = 'O')
SELECT edge_id, 'ADDED' AS change FROM b WHERE edge_id NOT IN (SELECT edge_id FROM a) UNION ALL SELECT edge_id, 'REMOVED' FROM a WHERE edge_id NOT IN (SELECT edge_id FROM b)""")
def edge_set_changes(spark, sf):
    e = table(spark, sf, "orders").select(F.col("o_custkey").alias("edge_id"), "o_orderstatus")
    return projects.edge_changes(e.where("o_orderstatus = 'F'"), e.where("o_orderstatus = 'O'"))


@query("""WITH f AS (SELECT doc_id, sha256(text) AS h FROM documents), g AS (SELECT *, count(*) OVER (PARTITION BY h) AS n, row_number() OVER (PARTITION BY h ORDER BY lpad(CAST(doc_id AS VARCHAR), 9, '0')) AS r FROM f)
SELECT lpad(CAST(a.doc_id AS VARCHAR), 9, '0') AS path_key, a.n - 1 AS matches, lpad(CAST(b.doc_id AS VARCHAR), 9, '0') AS first_match FROM g a JOIN g b ON a.h = b.h AND b.r = CASE WHEN a.r = 1 THEN 2 ELSE 1 END WHERE a.n > 1""")
def content_matches(spark, sf):
    return projects.content_matches(files(spark, sf).select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path_key"), "sha256", F.lit("present").alias("status")))


@query("""WITH e AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS edge_id, CAST(l_suppkey AS BIGINT) AS source, CAST(l_partkey AS BIGINT) AS target, CAST(l_partkey + l_linenumber % 2 AS BIGINT) AS resolved FROM lineitem), n AS (SELECT CAST(s_suppkey AS BIGINT) AS path_key FROM supplier)
SELECT DISTINCT path_key, edge_id, 'in' AS direction FROM n JOIN e ON target = path_key OR resolved = path_key UNION ALL SELECT path_key, edge_id, 'out' FROM n JOIN e ON source = path_key""")
def edges_in_and_out(spark, sf):
    e = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.col("l_suppkey").cast("long").alias("source"), F.col("l_partkey").cast("long").alias("target"), (F.col("l_partkey") + F.col("l_linenumber") % 2).cast("long").alias("resolved")).distinct()
    return projects.edges_of(table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("path_key")), e)


@query(EVENT_SQL + """SELECT (SELECT count(*) FILTER (doc_id % 4 <> 0) FROM documents) AS files, (SELECT count(*) FROM documents) AS fingerprints, (SELECT count(*) FILTER (doc_id % 4 <> 0 AND lang = 'en') FROM documents) AS communication_records, (SELECT count(*) FROM customer) AS projects, (SELECT count(*) FILTER (c_acctbal >= 0) FROM customer) AS understood_projects,
(SELECT count(*) FROM lineitem) AS dependencies, (SELECT count(*) FILTER (o_orderstatus IN ('F', 'O')) FROM orders) AS authority_assets, (SELECT count(*) FROM region) AS aggregate_nodes, (SELECT count(*) FROM pages) AS file_cards, (SELECT count(*) FROM l) AS events, (SELECT count(*) FROM nation) AS snapshots, (SELECT count(*) FILTER (semantic_importance = 'HIGH') FROM l) AS open_asset_alerts""")
def status_counters(spark, sf):
    t = lambda n: table(spark, sf, n)
    f = t("documents").select(F.when(F.col("doc_id") % 4 == 0, "missing").otherwise("present").alias("status"), F.lit("s").alias("sample"), F.lit(None).cast("string").alias("sha256"), (F.col("lang") == "en").alias("is_communication"))
    p = t("customer").select(F.when(F.col("c_acctbal") >= 0, "understood").otherwise("heuristic").alias("status"))
    a = t("orders").select(F.when(F.col("o_orderstatus") == "F", "CANONICAL").when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("REFERENCE").alias("authority_level"))
    e = log(spark, sf)
    return projects.status_counters(f, p, t("lineitem"), a, t("region"), t("pages"), e, t("nation"), e.select(F.when(F.col("semantic_importance") == "HIGH", "OPEN").otherwise("RESOLVED").alias("status")))


# Lines of work: folders are made of a page's language and number, status documents of its place.
FOLDERS = ["01_paper", "audit", "data", "old_conference_final", "fluent_rebuild", "misc", "thesis extension", "handoff"]
STREAM_SQL = f"""
WITH f AS (SELECT concat('P', doc_id % 3) AS project, {FOLDERS!r}[doc_id % 8 + 1] AS folder, doc_id, n_chars AS size, CASE doc_id % 5 WHEN 0 THEN 'final.docx' WHEN 1 THEN 'a/b.txt' WHEN 2 THEN 'official.pdf' ELSE 'c.py' END AS rest FROM documents),
t AS (SELECT DISTINCT project, folder, CASE WHEN folder = 'fluent_rebuild' THEN 'Status: **active' WHEN folder = 'misc' THEN 'state = frozen and it is active' ELSE 'nothing' END AS text FROM f),
n AS (SELECT project, count(*) AS total FROM f GROUP BY 1),
g AS (SELECT project, folder, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_size, sum(CASE WHEN rest IN ('final.docx', 'official.pdf') THEN 1 ELSE 0 END) AS finals FROM f GROUP BY 1, 2),
s AS (SELECT g.*, folder IN ('01_paper', 'old_conference_final', 'fluent_rebuild', 'thesis extension') AS semantic FROM g JOIN n USING (project) WHERE folder NOT IN ('audit', 'data', 'handoff') AND (folder IN ('01_paper', 'old_conference_final', 'fluent_rebuild', 'thesis extension') OR file_count >= greatest(4, floor(total * 0.04)))),
k AS (SELECT *, CASE folder WHEN 'fluent_rebuild' THEN 16 WHEN 'misc' THEN 10 ELSE 0 END AS active, CASE WHEN finals >= 2 THEN 2 ELSE 0 END + CASE WHEN finals >= 2 AND contains(folder, 'extension') THEN 3 ELSE 0 END AS completed,
 CASE folder WHEN 'old_conference_final' THEN 10 WHEN 'misc' THEN 10 ELSE 0 END AS frozen FROM s),
r AS (SELECT project, folder, CASE folder WHEN '01_paper' THEN '01 paper' WHEN 'old_conference_final' THEN 'old conference final' WHEN 'fluent_rebuild' THEN 'fluent rebuild' ELSE folder END AS name,
 CASE WHEN greatest(active, completed, frozen) = 0 THEN 'UNKNOWN' WHEN active >= completed AND active >= frozen THEN 'ACTIVE' WHEN completed >= frozen THEN 'COMPLETED' ELSE 'FROZEN' END AS lifecycle, greatest(active, completed, frozen) AS score, semantic, file_count, total_size FROM k)
"""


def project_files(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    folder = F.element_at(F.array(*[F.lit(x) for x in FOLDERS]), (k % 8 + 1).cast("int"))
    rest = F.when(k % 5 == 0, "final.docx").when(k % 5 == 1, "a/b.txt").when(k % 5 == 2, "official.pdf").otherwise("c.py")
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("P"), (k % 3).cast("string")).alias("project"), folder.alias("folder"), F.concat_ws("/", folder, rest).alias("path"), F.col("n_chars").alias("size"))


def streams(spark: SparkSession, sf: str) -> DataFrame:
    f = project_files(spark, sf)
    text = F.when(F.col("folder") == "fluent_rebuild", "Status: **active").when(F.col("folder") == "misc", "state = frozen and it is active").otherwise("nothing")
    return projects.workstreams(f.select("project", "path", "size"), f.select("project", "folder", text.alias("text")).distinct())


@query(STREAM_SQL + "SELECT project, folder, name, lifecycle, CAST(score AS BIGINT) AS score, CAST(round(least(0.94, 0.52 + 0.08 * score + CASE WHEN semantic THEN 0.08 ELSE 0 END), 3) AS DOUBLE) AS confidence, file_count, total_size FROM r")
def workstreams(spark, sf):
    return streams(spark, sf).withColumn("confidence", F.round("confidence", 3))


@query(STREAM_SQL + """, x AS (SELECT project, lifecycle AS s FROM r WHERE lifecycle <> 'UNKNOWN' UNION SELECT 'P1', 'COMPLETED' UNION SELECT 'Q', 'FROZEN' UNION SELECT 'R', NULL), c AS (SELECT project, count(DISTINCT s) AS n, min(s) AS s FROM x GROUP BY 1) SELECT project, CASE WHEN n > 1 THEN 'MIXED' WHEN n = 1 THEN s ELSE 'UNKNOWN' END AS lifecycle FROM c""")
def project_lifecycle(spark, sf):
    said = spark.createDataFrame([("P1", "It was submitted."), ("Q", "All is locked"), ("R", "no word of it")], "project string, text string")
    every = project_files(spark, sf).select("project").union(said.select("project")).distinct()
    return projects.project_lifecycle(every, streams(spark, sf), said)


@query("""WITH d AS (SELECT concat('P', doc_id % 40) AS project, lower(concat(text, CASE doc_id % 40 WHEN 1 THEN ' CFD and cold plate ' WHEN 2 THEN ' Fluent COMSOL thermoelectric' ELSE '' END)) AS t FROM documents),
k AS (SELECT * FROM (VALUES (0, 'steg', 'STEG'), (1, 'thermoelectric', 'thermoelectric'), (3, 'cold plate', 'cold-plate'), (4, 'cold-plate', 'cold-plate'), (6, 'comsol', 'COMSOL simulation'), (7, 'fluent', 'Fluent/CFD'), (8, 'cfd', 'CFD'), (9, 'topology optimization', 'topology optimization'), (11, 'heat transfer', 'heat-transfer')) v(i, n, s)),
h AS (SELECT project, s, min(i) AS i FROM d JOIN k ON contains(t, n) GROUP BY 1, 2) SELECT project, list(s ORDER BY i, s) AS subjects, CAST(round(least(0.92, 0.62 + 0.06 * count(*)), 3) AS DOUBLE) AS confidence FROM h GROUP BY 1""")
def project_subjects(spark, sf):
    k = F.col("doc_id") % 40
    more = F.when(k == 1, " CFD and cold plate ").when(k == 2, " Fluent COMSOL thermoelectric").otherwise("")
    out = projects.project_subjects(table(spark, sf, "documents").select(F.concat(F.lit("P"), k.cast("string")).alias("project"), F.concat("text", more).alias("text")))
    return out.withColumn("confidence", F.round("confidence", 3))


@query(STREAM_SQL + """, q AS (SELECT f.project, f.folder AS workstream, CASE f.rest WHEN 'final.docx' THEN 'documentation' WHEN 'a/b.txt' THEN 'documentation' WHEN 'official.pdf' THEN 'report' ELSE 'code' END AS role, count(*) AS n FROM f JOIN r USING (project, folder) GROUP BY ALL)
SELECT project AS node, NULL AS parent, 'project' AS node_type, project AS label FROM n UNION ALL SELECT concat(project, '/', folder), project, 'workstream', name FROM r
UNION ALL SELECT concat(project, '/', workstream, '/', role), concat(project, '/', workstream), 'asset_group', concat(role, ' (', n, ')') FROM q
UNION ALL SELECT DISTINCT concat(project, '/', folder), project, CASE folder WHEN 'audit' THEN 'archive' ELSE 'deliverable' END, folder FROM f WHERE folder IN ('audit', 'handoff')""")
def project_tree(spark, sf):
    f, s = project_files(spark, sf), streams(spark, sf)
    roles = paths.lookup(paths.ROLE_EXTENSIONS, paths.extension(F.col("path")))
    held = f.join(s.select("project", "folder"), ["project", "folder"], "left_semi").select("project", F.col("folder").alias("workstream"), roles.alias("role"))
    return projects.tree_nodes(f.select("project").distinct(), s, projects.role_groups(held), f)


# A run: what is unique in content and has gone and come is moved, what has come and is also still there is a copy.
RUN_SQL = CONTENT_SQL + """, g1 AS (SELECT size, sha256, min(path_key) AS p FROM gone GROUP BY ALL HAVING count(*) = 1), c1 AS (SELECT size, sha256, min(path_key) AS p FROM come GROUP BY ALL HAVING count(*) = 1),
mv AS (SELECT CASE WHEN regexp_replace(g1.p, '/?[^/]*$', '') = regexp_replace(c1.p, '/?[^/]*$', '') THEN 'RENAMED' ELSE 'MOVED' END AS way, g1.p AS src, c1.p AS dst FROM g1 JOIN c1 USING (size, sha256)),
cp AS (SELECT 'COPIED' AS way, min(h.path_key) AS src, c.path_key AS dst FROM come c JOIN here h ON c.size = h.size AND c.sha256 = h.sha256 WHERE c.path_key NOT IN (SELECT dst FROM mv) GROUP BY c.path_key),
tr AS (SELECT * FROM mv UNION ALL SELECT * FROM cp),
am AS (SELECT path_key, CASE length(path_key) % 3 WHEN 0 THEN 'manuscript' WHEN 1 THEN 'code' ELSE 'figure' END AS role, CASE length(path_key) % 4 WHEN 0 THEN 'CANONICAL' ELSE 'REFERENCE' END AS auth FROM f),
pr AS (SELECT size, sha256, min(path_key) AS s FROM f WHERE doc_id % 10 <> 7 GROUP BY ALL),
x AS (SELECT d.path_key, d.change_type, coalesce(d.before_size, 0) AS b, coalesce(d.after_size, 0) AS a, tr.way, tr.src, f.size, f.sha256, m1.role AS r1, m1.auth AS a1, m2.role AS r2, m2.auth AS a2, pr.s AS survivor
  FROM d JOIN f USING (path_key) LEFT JOIN tr ON tr.dst = d.path_key LEFT JOIN am m1 ON m1.path_key = tr.src JOIN am m2 ON m2.path_key = d.path_key LEFT JOIN pr ON d.change_type = 'MISSING' AND pr.size = f.size AND pr.sha256 = f.sha256
  WHERE d.path_key NOT IN (SELECT src FROM mv) AND f.doc_id % 23 <> 0),
y AS (SELECT *, way IS NOT NULL AS sure FROM x)
"""
RUN_EVENTS_SQL = RUN_SQL + """, ev AS (SELECT path_key, src AS source_path_key, concat('FILE_', way) AS event_type, 0 AS size_delta, 'identity_resolved' AS resolution_status FROM y WHERE sure
UNION ALL SELECT path_key, src, 'ROLE_CHANGED', 0, NULL FROM y WHERE way IN ('MOVED', 'RENAMED') AND r1 <> r2
UNION ALL SELECT path_key, src, 'AUTHORITY_CHANGED', 0, NULL FROM y WHERE way IN ('MOVED', 'RENAMED') AND a1 <> a2
UNION ALL SELECT path_key, NULL, 'FILE_CREATED', a, NULL FROM y WHERE NOT sure AND change_type = 'NEW'
UNION ALL SELECT path_key, NULL, 'FILE_REAPPEARED', a, NULL FROM y WHERE NOT sure AND change_type = 'REAPPEARED'
UNION ALL SELECT path_key, NULL, 'FILE_CHANGED', a - b, NULL FROM y WHERE NOT sure AND change_type = 'CHANGED'
UNION ALL SELECT path_key, NULL, CASE WHEN a > b THEN 'FILE_SIZE_GROWTH' ELSE 'FILE_SIZE_SHRINK' END, a - b, NULL FROM y WHERE NOT sure AND change_type = 'CHANGED' AND a <> b AND abs(a - b) * 4 >= greatest(1, b)
UNION ALL SELECT path_key, NULL, 'FILE_MISSING', -b, CASE WHEN survivor IS NULL THEN 'unresolved_missing' ELSE 'content_copy_verified' END FROM y WHERE NOT sure AND change_type = 'MISSING'
UNION ALL SELECT path_key, NULL, 'POSSIBLE_ASSET_LOSS', 0, 'open_alert' FROM y WHERE NOT sure AND change_type = 'MISSING' AND survivor IS NULL AND (r2 = 'manuscript' OR a2 = 'CANONICAL')
UNION ALL SELECT 'volatile:lock_file', NULL, 'VOLATILE_CHANGE_AGGREGATE', CAST(sum(coalesce(after_size, 0) - coalesce(before_size, 0)) AS BIGINT), NULL FROM d JOIN f USING (path_key) WHERE f.doc_id % 23 = 0 HAVING count(*) > 0)
"""


def run_events(spark: SparkSession, sf: str) -> DataFrame:
    gone, come, here = contents(spark, sf)
    moves = changes.exact_moves(gone, come)
    copies = changes.copy_candidates(come.join(moves.select(F.col("target_path_key").alias("path_key")), "path_key", "left_anti"), here).withColumn("event_type", F.lit("COPIED"))
    transitions = moves.unionByName(copies)
    every = files(spark, sf)
    d = changes.diff(old_files(spark, sf), new_files(spark, sf))
    d = d.join(every.select("path_key", "doc_id"), "path_key").withColumn("volatile_class", F.when(F.col("doc_id") % 23 == 0, "lock_file"))
    n = F.length("path_key")
    assets = every.select("path_key", F.when(n % 3 == 0, "manuscript").when(n % 3 == 1, "code").otherwise("figure").alias("role"), F.when(n % 4 == 0, "CANONICAL").otherwise("REFERENCE").alias("authority_level"), F.lit(None).cast("string").alias("superseded_by"))
    present = every.where("doc_id % 10 <> 7")
    sample = F.lit(None).cast("string").alias("sample")
    lost = d.where("change_type = 'MISSING'").join(every.select("path_key", "size", "sha256"), "path_key").select("path_key", "size", "sha256", sample)
    found = maintenance.surviving_copies(lost, present.select("path_key", "size", "sha256", sample))
    return maintenance.maintenance_events(d, transitions, assets, found, present.select("path_key"))


@query(RUN_EVENTS_SQL + "SELECT path_key, source_path_key, event_type, size_delta, resolution_status FROM ev")
def maintenance_events(spark, sf):
    return run_events(spark, sf)


@query(RUN_EVENTS_SQL + """, had AS (SELECT path_key, 'OPEN' AS status FROM f WHERE doc_id % 10 = 3 OR doc_id % 17 = 0 OR doc_id % 100 = 7), lost AS (SELECT DISTINCT path_key FROM ev WHERE event_type = 'POSSIBLE_ASSET_LOSS'),
back AS (SELECT path_key FROM ev WHERE event_type IN ('FILE_REAPPEARED', 'FILE_MOVED', 'FILE_RENAMED', 'FILE_COPIED') UNION SELECT source_path_key FROM ev WHERE event_type IN ('FILE_REAPPEARED', 'FILE_MOVED', 'FILE_RENAMED', 'FILE_COPIED') AND source_path_key IS NOT NULL)
SELECT path_key, 'OPEN' AS status FROM lost UNION ALL SELECT path_key, CASE WHEN path_key IN (SELECT path_key FROM back) THEN 'RESOLVED' ELSE status END FROM had WHERE path_key NOT IN (SELECT path_key FROM lost)""")
def alerts_after_run(spark, sf):
    had = files(spark, sf).where("doc_id % 10 = 3 or doc_id % 17 = 0 or doc_id % 100 = 7").select("path_key", F.lit("OPEN").alias("status"))
    return maintenance.alerts_after(had, run_events(spark, sf))


@query("""WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS path_key, n_chars AS size, doc_id AS modified, lang, doc_id FROM documents), h AS (SELECT * FROM f WHERE doc_id % 4 <> 0), g AS (SELECT sum(length(html)) AS s, count(*) AS n FROM pages)
SELECT CAST((SELECT count(*) FROM h) + g.n AS BIGINT) AS files_count, CAST((SELECT sum(size) FROM h) + g.s AS BIGINT) AS logical_size, (SELECT max(modified) FROM h) AS last_modified, CAST(g.s AS BIGINT) AS aggregate_size, CAST(g.s AS BIGINT) AS potential_cleanup, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM h WHERE lang = 'en') AS potential_archive,
 (SELECT count(*) FROM f WHERE doc_id % 3 = 0) AS authority_asset_count, (SELECT count(*) FROM customer) AS project_count, (SELECT count(*) FROM customer WHERE c_nationkey < 10) AS active_projects, (SELECT count(*) FROM customer WHERE c_nationkey >= 20) AS frozen_projects FROM g""")
def snapshot_global(spark, sf):
    d = table(spark, sf, "documents")
    key = F.col("doc_id").cast("string").alias("path_key")
    f = d.select(key, F.col("n_chars").alias("size"), F.col("doc_id").alias("modified"), F.when(F.col("doc_id") % 4 == 0, "missing").otherwise("present").alias("status"))
    a = d.select(key, F.when(F.col("doc_id") % 3 == 0, "CANONICAL").otherwise("REFERENCE").alias("authority_level"), F.when(F.col("lang") == "en", "REVIEW_A").otherwise("KEEP").alias("archive_recommendation"))
    g = table(spark, sf, "pages").select(F.lit(1).alias("file_count"), F.length("html").alias("total_size"))
    n = F.col("c_nationkey")
    p = table(spark, sf, "customer").select(F.when(n < 10, "ACTIVE").when(n >= 23, "COMPLETED").when(n >= 20, "FROZEN").otherwise("UNKNOWN").alias("activity_status"))
    return maintenance.global_snapshot(f, g, a, p)


@query("SELECT o_orderkey AS snapshot_id, o_orderdate AS created_at FROM orders WHERE o_orderpriority LIKE '1%' AND CAST(o_orderdate AS TIMESTAMP) < TIMESTAMP '1997-01-01 00:00:00' - INTERVAL 90 DAY")
def daily_snapshots_eligible(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderpriority").like("1%"), "daily").otherwise("weekly").alias("snapshot_kind"))
    return maintenance.daily_snapshots_to_drop(o, F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")).select("snapshot_id", "created_at")


@query(EVENT_SQL + "SELECT event_id, event_type FROM l WHERE event_id % 9 = (SELECT CAST(max(n_nationkey) FILTER (n_regionkey < 2) % 9 AS BIGINT) FROM nation)")
def events_since_last_run(spark, sf):
    runs = table(spark, sf, "nation").select((F.col("n_nationkey") % 9).cast("long").alias("run_id"), F.col("n_nationkey").alias("created_at"), F.when(F.col("n_regionkey") == 0, "MAINTENANCE").when(F.col("n_regionkey") == 1, "WEEKLY_DEEP_MAINTENANCE").otherwise("ONBOARD").alias("mode"))
    return maintenance.since_last_run(runs, log(spark, sf).withColumn("run_id", F.col("event_id") % 9)).select("event_id", "event_type")


@query("""WITH t AS (SELECT doc_id, quality AS q, true AS active, 1 AS upd FROM labels), s AS (SELECT doc_id, 9 AS q, true AS active, 2 AS upd FROM labels WHERE toxic = 1), u AS (SELECT * FROM t WHERE doc_id NOT IN (SELECT doc_id FROM s) UNION ALL SELECT * FROM s)
SELECT CAST(doc_id AS VARCHAR) AS subject_key, CAST(q AS VARCHAR) AS value, active AND doc_id % 5 <> 0 AS active, upd AS updated_at FROM u""")
def assertions_set_and_removed(spark, sf):
    la = table(spark, sf, "labels")
    row = lambda d, v, at: d.select(F.lit("asset").alias("subject_type"), F.col("doc_id").cast("string").alias("subject_key"), F.lit("role").alias("predicate"), v.cast("string").alias("value"), F.lit(True).alias("active"), F.lit(at).alias("updated_at"))
    held = maintenance.set_assertions(row(la, F.col("quality"), 1), row(la.where("toxic = 1"), F.lit(9), 2))
    out = maintenance.remove_assertions(held, row(la.where("doc_id % 5 = 0"), F.lit(0), 0))
    return out.select("subject_key", "value", "active", "updated_at")


@query(f"SELECT event_id, occurred_at AS timestamp, importance_score FROM ({EVENT_SQL} SELECT * FROM l) WHERE occurred_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND occurred_at <= TIMESTAMP '{AS_OF}'")
def events_of_days(spark, sf):
    at = F.lit(AS_OF).cast("timestamp_ntz")
    return history.public_events(history.in_range(log(spark, sf), history.days_before(at, 7), at)).select("event_id", "timestamp", "importance_score")


@query("""SELECT c.c_custkey AS project_id, s.day, row_number() OVER (PARTITION BY c.c_custkey ORDER BY s.day DESC) AS rank, s.total_size FROM customer c JOIN (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, CAST(sum(round(o_totalprice)) AS BIGINT) AS total_size FROM orders GROUP BY ALL) s ON s.o_custkey = c.c_custkey QUALIFY rank <= 100""")
def project_snapshots_listed(spark, sf):
    s = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("project_id"), F.to_date("o_orderdate").alias("day")).agg(F.sum(F.round("o_totalprice")).cast("long").alias("total_size"))
    known = table(spark, sf, "customer").select(F.col("c_custkey").alias("project_id"))
    return history.top_per_group(s.join(known, "project_id"), "project_id", [F.desc("day")], 100).select("project_id", "day", "rank", "total_size")


@query("""WITH p AS (SELECT p_partkey, regexp_replace(lower(p_name), '[0-9]+', '') AS family, p_retailprice, p_size, p_partkey % 4 = 0 AS strong FROM part), r AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY strong DESC, p_retailprice DESC, p_partkey) AS rank, first_value(p_partkey) OVER (w ORDER BY strong DESC, p_retailprice DESC, p_partkey) AS top, first_value(p_size) OVER (w ORDER BY strong DESC, p_retailprice DESC, p_partkey) AS top_size FROM p WINDOW w AS (PARTITION BY family))
SELECT p_partkey, CASE WHEN rank > 1 AND NOT strong AND (p_size < 5 OR p_size = top_size) THEN top END AS superseded_by FROM r WHERE n > 1""")
def superseded_in_families(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.regexp_replace(F.lower("p_name"), "[0-9]+", "").alias("family"), "p_retailprice", F.col("p_size").cast("string").alias("folder"), (F.col("p_partkey") % 4 == 0).alias("strong"), F.lit(True).alias("version_signalled"), (F.col("p_size") < 5).alias("historical"))
    order = [F.desc("strong"), F.desc("p_retailprice"), F.col("p_partkey")]
    return matching.superseded(p, "family", order, "p_partkey").select("p_partkey", "superseded_by")
