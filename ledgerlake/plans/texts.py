"""Text, references and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions import paths, text
from ledgerlake.operators import audit, matching

from .registry import query, table

# Patterns without look-around, the same in both engines.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "credential": text.PRIVACY_PATTERNS["credential"],
    "known_token": text.PRIVACY_PATTERNS["known_token"],
    "license": r"(?i)licen[sc]e",
    "number": r"[0-9]{3,}",
}
LINES_SQL = r"""
WITH a AS (SELECT doc_id, string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM documents),
li AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM a)
"""


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return text.lines(table(spark, sf, "documents"), "doc_id", "text")


def _findings_sql() -> str:
    one = "\nUNION ALL ".join(f"SELECT doc_id, line_no, '{c}' AS category, len(regexp_extract_all(line, '{p.replace(chr(39), chr(39) * 2)}')) AS hits FROM li" for c, p in PLAIN.items())
    return LINES_SQL + f", h AS ({one}) SELECT doc_id, category, CAST(sum(hits) AS BIGINT) AS hits, list_sort(list(line_no)) AS line_numbers FROM h WHERE hits > 0 GROUP BY ALL"


@query(_findings_sql())
def privacy_findings(spark, sf):
    return text.findings(doc_lines(spark, sf), "doc_id", PLAIN)


@query()
def privacy_findings_exact(spark, sf):
    """With look-behind, which the SQL engine's patterns lack."""
    return text.findings(doc_lines(spark, sf), "doc_id", text.PRIVACY_PATTERNS)


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS ref FROM pages) SELECT page_id, ref, count(*) AS n FROM l GROUP BY ALL""")
def href_references(spark, sf):
    return links(spark, sf).groupBy("page_id", "ref").agg(F.count("*").alias("n"))


def links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("ref"))


LINK_SQL = r"""
WITH l AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS site, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS ref FROM pages),
t AS (SELECT DISTINCT page_id, concat(site, ref) AS target FROM l WHERE ref <> '' AND NOT regexp_matches(ref, '^(#|https?://|mailto:)')),
k AS (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS target FROM pages UNION SELECT DISTINCT concat(regexp_extract(url, '^[a-z]+://[^/?#]*', 0), '/The') FROM pages)
"""


def targets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    site = F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0)
    t = links(spark, sf).where("ref <> ''").where(~F.rlike("ref", F.lit("^(#|https?://|mailto:)"))).select("page_id", F.concat(site, "ref").alias("target")).distinct()
    p = table(spark, sf, "pages")
    return t, p.select(F.regexp_replace("url", "[?#].*$", "").alias("path")).union(p.select(F.concat(site, F.lit("/The")))).distinct()


PLACE_SQL = """
WITH d AS (SELECT source, doc_id, concat(source, '/', lang, '/doc', doc_id, '.txt') AS src, doc_id % 6 AS k, lang FROM documents),
r AS (SELECT src, CASE k WHEN 0 THEN concat('doc', doc_id + 20, '.txt') WHEN 1 THEN concat('../', lang, '/doc', doc_id, '.txt') WHEN 2 THEN concat(source, '/', lang) WHEN 3 THEN 'x.exe' WHEN 4 THEN 'C:\\d\\m.mph' ELSE 'a/b.md#top' END AS target,
 CASE k WHEN 0 THEN concat(source, '/', lang, '/doc', doc_id + 20, '.txt') WHEN 1 THEN src WHEN 2 THEN concat(source, '/', lang) WHEN 4 THEN 'C:/d/m.mph' WHEN 5 THEN concat(source, '/', lang, '/a/b.md#top') END AS resolved, k, source, lang, doc_id FROM d)
SELECT src AS source, target, resolved, CASE k WHEN 1 THEN 'resolved_existing' WHEN 2 THEN 'resolved_existing' WHEN 3 THEN 'not_file_like' WHEN 0 THEN CASE WHEN resolved IN (SELECT src FROM d) THEN 'resolved_existing' ELSE 'resolved_missing' END ELSE 'resolved_missing' END AS resolution_status FROM r
"""


@query(PLACE_SQL)
def placed_references(spark, sf):
    k, n = F.col("doc_id") % 6, F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", F.concat("source", F.lit("/"), "lang", F.lit("/doc"), n.cast("string"), F.lit(".txt")).alias("src"))
    target = (
        F.when(k == 0, F.concat(F.lit("doc"), (n + 20).cast("string"), F.lit(".txt"))).when(k == 1, F.concat(F.lit("../"), "lang", F.lit("/doc"), n.cast("string"), F.lit(".txt")))
        .when(k == 2, F.concat("source", F.lit("/"), "lang")).when(k == 3, "x.exe").when(k == 4, "C:\\d\\m.mph").otherwise("a/b.md#top")
    )
    refs = d.select(F.col("src").alias("source"), target.alias("target"))
    return matching.place_references(refs, d.select("src"), "target", "source", "src")


@query(LINK_SQL + "SELECT page_id, target, CASE WHEN k.target IS NULL THEN 'resolved_missing' ELSE 'resolved_existing' END AS resolution_status FROM t LEFT JOIN k USING (target)")
def reference_resolution(spark, sf):
    t, k = targets(spark, sf)
    return matching.resolve_references(t, k, "target", "path").select("page_id", "target", "resolution_status")


@query(LINK_SQL + "SELECT page_id, count(*) AS broken FROM t WHERE target NOT IN (SELECT target FROM k) GROUP BY 1")
def broken_references(spark, sf):
    t, k = targets(spark, sf)
    return t.join(k, t["target"] == k["path"], "left_anti").groupBy("page_id").agg(F.count("*").alias("broken"))


@query(LINK_SQL + "SELECT target, count(*) AS in_degree FROM t GROUP BY 1")
def reference_in_degree(spark, sf):
    return matching.in_degree(targets(spark, sf)[0], "target")


@query("""SELECT doc_id, item_id FROM documents JOIN benchmark b ON contains(concat(' ', documents.text, ' '), concat(' ', b.text, ' '))""")
def denylist_hits(spark, sf):
    """Whole benchmark items stand for denied phrases."""
    return matching.contained_phrases(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "item_id").select("doc_id", "item_id")


@query("""SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations""")
def section_state(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w).alias("section"))


@query()
def authority_declarations(spark, sf):
    """Headings and declarations over conversations turned into Markdown; the patterns need look-behind."""
    c = table(spark, sf, "conversations").select("conv_id", F.concat(F.when(F.col("turn") % 2 == 0, F.lit("# Authoritative model\n")).otherwise(F.lit("")), F.lit("- see `data/turn"), F.col("turn").cast("string"), F.lit(".csv` and the canonical one\n"), F.col("text")).alias("text"))
    return text.authority_declarations(text.lines(c, "conv_id", "text"), "conv_id")


@query("SELECT doc_id, 1 AS line_no, concat('a/old', source, '.csv') AS predecessor, concat('b/new', lang, '.csv') AS successor FROM documents")
def supersession_edges(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("`a/old"), F.col("source"), F.lit(".csv` is superseded by `b/new"), F.col("lang"), F.lit(".csv`\n"), F.col("text")).alias("text"))
    return text.supersessions(text.lines(d, "doc_id", "text"), "doc_id")


@query("""SELECT source, lang, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) = 1""")
def supersession_latest(spark, sf):
    from ledgerlake.operators.changes import latest_state

    return latest_state(table(spark, sf, "documents").select("source", "lang", "doc_id", "n_chars").withColumn("k", F.concat_ws("/", "source", "lang")), "k", [F.desc("n_chars"), F.col("doc_id")]).drop("k")


ENTRY_SQL = """
WITH e AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, CASE WHEN page_id % 9 = 0 THEN 'directory' ELSE 'file' END AS entry_kind, length(html) AS size_bytes,
 sha256(html) AS sha256, CASE WHEN page_id % 5 = 0 THEN 'SKIPPED' ELSE 'PASS' END AS hash_status, CASE WHEN page_id % 31 = 0 THEN 'PARTIAL' ELSE 'PASS' END AS scan_status FROM pages)
"""


def entries(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id")
    return table(spark, sf, "pages").select(
        "page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"), F.when(k % 9 == 0, "directory").otherwise("file").alias("entry_kind"),
        F.length("html").alias("size_bytes"), F.sha2("html", 256).alias("sha256"), F.when(k % 5 == 0, "SKIPPED").otherwise("PASS").alias("hash_status"), F.when(k % 31 == 0, "PARTIAL").otherwise("PASS").alias("scan_status"),
    )


LABEL_SQL = ENTRY_SQL + """, p AS (SELECT *, string_split(lower(path), '/') AS parts FROM e), c AS (SELECT page_id, CASE WHEN list_has_any(parts, ['de']) THEN 'cache' WHEN entry_kind <> 'file' THEN 'unknown' WHEN list_has_any(parts, ['fr']) THEN 'source' WHEN list_has_any(parts, ['es']) THEN 'result'
 WHEN regexp_matches(path, '\\.(yaml|yml|json|toml|ini|cfg)$') OR list_contains(parts, 'config') THEN 'config' WHEN regexp_matches(path, '\\.(py|m|java|c|cpp|h|hpp|f90|sh|ps1|ipynb)$') OR list_has_any(parts, ['scripts', 'code']) THEN 'code'
 WHEN regexp_matches(path, '[^/]\\.(md|pdf|docx|pptx|html)$') OR starts_with(regexp_extract(lower(path), '([^/]*)$', 1), 'readme') THEN 'report' ELSE 'unknown' END AS label FROM p)
"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    return e.select("page_id", audit.classify(F.col("path"), F.col("entry_kind"), ["de"], ["fr"], ["es"]).alias("label"))


@query(LABEL_SQL + "SELECT page_id, label FROM c")
def classification(spark, sf):
    return labelled(spark, sf)


@query(LABEL_SQL + ", k AS (SELECT unnest(['source', 'code', 'config', 'result', 'report', 'cache', 'unknown']) AS label) SELECT k.label, count(c.page_id) AS n FROM k LEFT JOIN c ON k.label = c.label GROUP BY 1")
def classification_counts(spark, sf):
    return audit.label_counts(labelled(spark, sf))


@query(ENTRY_SQL + "SELECT count(*) AS entries, count(*) FILTER (entry_kind = 'file') AS files, count(*) FILTER (hash_status = 'PASS') AS hashed, count(*) FILTER (scan_status <> 'PASS') AS incomplete, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM e")
def inventory_summary(spark, sf):
    return audit.inventory_summary(entries(spark, sf))


@query("SELECT 'LARGE_FILE' AS risk_type, 'medium' AS severity, [CAST(doc_id AS VARCHAR)] AS relative_paths, true AS requires_human_decision, false AS automatic_disposition_authorized FROM documents WHERE n_chars >= 10000")
def large_files(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("file").alias("entry_kind"), F.col("n_chars").alias("size_bytes"))
    return audit.large_file_risks(d, 10_000)


@query("""WITH r AS (SELECT 'DUPLICATE_CANDIDATE' AS risk_type, list_sort(list(lpad(CAST(doc_id AS VARCHAR), 9, '0'))) AS relative_paths FROM documents GROUP BY sha256(text) HAVING count(*) > 1
UNION ALL SELECT 'LARGE_FILE', [lpad(CAST(doc_id AS VARCHAR), 9, '0')] FROM documents WHERE n_chars >= 10000)
SELECT risk_type, relative_paths, printf('RISK-%04d', row_number() OVER (ORDER BY risk_type, relative_paths)) AS risk_id FROM r""")
def risk_register(spark, sf):
    d = table(spark, sf, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.lit("file").alias("entry_kind"), F.col("n_chars").alias("size_bytes"), F.sha2("text", 256).alias("sha256"))
    return audit.register(audit.duplicate_risks(d), audit.large_file_risks(d, 10_000)).select("risk_type", "relative_paths", "risk_id")


@query("SELECT CAST(c_custkey AS VARCHAR) AS path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0)")
def expected_outputs_missing(spark, sf):
    want = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("path"))
    have = table(spark, sf, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").cast("string").alias("path")).distinct()
    return audit.missing_output_risks(want, have).select(F.get("relative_paths", F.lit(0)).alias("path"))


@query(ENTRY_SQL + "SELECT page_id, path IN (SELECT path FROM e WHERE page_id % 4 = 0) AND entry_kind = 'file' AS entrypoint FROM e")
def entrypoint_candidates(spark, sf):
    e = entries(spark, sf)
    known = e.where("page_id % 4 = 0").select("path").distinct().withColumn("_k", F.lit(True))
    return e.join(known, "path", "left").select("page_id", (F.coalesce("_k", F.lit(False)) & (F.col("entry_kind") == "file")).alias("entrypoint"))


@query("""WITH l AS (SELECT concat(source, '/doc', doc_id, '.md') AS path, concat(source, '/doc', doc_id + 20, '.md') AS missing FROM documents UNION ALL SELECT concat(source, '/doc', doc_id, '.md'), concat(source, '/none.md') FROM documents)
SELECT path, missing FROM l WHERE missing NOT IN (SELECT concat(source, '/doc', doc_id, '.md') FROM documents)""")
def broken_markdown_links(spark, sf):
    """Links resolved against their document's folder; the SQL has the resolved paths of these made-up links."""
    d = table(spark, sf, "documents").select(F.concat("source", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("[a](doc"), (F.col("doc_id") + 20).cast("string"), F.lit(".md) [b](../"), F.col("source"), F.lit("/none.md) [c](../../out.md) [d]( )")).alias("text"))
    return audit.broken_links(d, d.select("path"), "path", "text")


@query(LINES_SQL + r"""
, k AS (SELECT unnest(['license', 'the', 'idiot']) AS tool), m AS (SELECT k.tool, CASE WHEN regexp_matches(line, '(?i)reference|supporting') THEN 'reference' WHEN regexp_matches(line, '(?i)primary|main') THEN 'primary' ELSE 'supporting' END AS kind, len(regexp_extract_all(lower(line), concat('\b', k.tool, '\b'))) AS n FROM li, k),
w AS (SELECT tool, coalesce(sum(n) FILTER (kind = 'primary'), 0) AS p, coalesce(sum(n) FILTER (kind = 'supporting'), 0) AS s, coalesce(sum(n) FILTER (kind = 'reference'), 0) AS r FROM m WHERE n > 0 GROUP BY 1),
nat AS (SELECT CASE WHEN regexp_matches(text, '(?i)license') THEN 'license' ELSE 'the' END AS tool, n_chars * 100000 AS size, coalesce(regexp_matches(text, '(?i)reference|supporting'), false) AS ref FROM documents),
n AS (SELECT tool, count(*) AS native, count(*) FILTER (NOT ref) AS pn, count(*) FILTER (ref) AS rn, sum(CASE WHEN NOT ref THEN least(12.0, size / 536870912.0) ELSE 0 END) AS big FROM nat GROUP BY 1),
j AS (SELECT coalesce(n.tool, w.tool) AS tool, coalesce(native, 0) AS native, coalesce(pn, 0) AS pn, coalesce(rn, 0) AS rn, coalesce(p, 0) AS p, coalesce(s, 0) AS s, coalesce(r, 0) AS r, coalesce(big, 0) AS big FROM n FULL JOIN w ON n.tool = w.tool),
c AS (SELECT *, round(least(40.0, pn * 4.0 + rn * 0.5 + big) + least(35.0, p * 8.0) + least(12.0, s * 0.5) + least(3.0, r * 0.1), 3) AS score FROM j), t AS (SELECT *, max(score) OVER () AS top, row_number() OVER (ORDER BY score DESC, tool) AS nth FROM c WHERE score > 0)
SELECT tool, native, pn AS primary_native, rn AS reference_native, CAST(p AS BIGINT) AS "primary", CAST(s AS BIGINT) AS supporting, CAST(r AS BIGINT) AS reference, CAST(score AS DOUBLE) AS score, CASE WHEN nth = 1 AND (native > 0 OR score >= 8) THEN 'PRIMARY_TOOL' WHEN (pn > 0 OR p >= greatest(2.0, r * 0.25)) AND score >= greatest(6.0, top * 0.35) THEN 'SECONDARY_TOOL' ELSE 'REFERENCE_TOOL' END AS centrality FROM t
""")
def tool_mentions_ranked(spark, sf):
    """Centrality of terms: capped scores over mentions per line and native assets."""
    d = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    terms = F.array(*[F.struct(F.lit(t).alias("tool"), F.lit(t).alias("term")) for t in ("license", "the", "idiot")])
    li = text.lines(d, "doc_id", "text").select("line", F.explode(terms).alias("t"))
    n = F.regexp_count(F.lower("line"), F.concat(F.lit(r"\b"), F.col("t.term"), F.lit(r"\b")))
    kind = F.when(F.rlike("line", F.lit("(?i)reference|supporting")), "reference").when(F.rlike("line", F.lit("(?i)primary|main")), "primary").otherwise("supporting")
    mentions = li.select(F.col("t.tool").alias("tool"), kind.alias("kind"), n.alias("n")).where("n > 0").groupBy("tool", "kind").agg(F.sum("n").alias("n"))
    native = d.select(F.when(F.rlike("text", F.lit("(?i)license")), "license").otherwise("the").alias("tool"), (F.col("n_chars") * 100_000).alias("size"), F.rlike("text", F.lit("(?i)reference|supporting")).alias("in_reference")).na.fill({"tool": "the", "in_reference": False})
    return audit.tool_centrality(native, mentions)


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'deliverable' WHEN 1 THEN 'raw_data' ELSE 'documentation' END AS role, CASE page_id % 3 WHEN 0 THEN 'CANONICAL' WHEN 1 THEN 'HISTORICAL' ELSE 'REFERENCE' END AS authority,
 CAST(CASE page_id % 3 WHEN 0 THEN 0.84 WHEN 1 THEN 0.82 ELSE 0.9 END AS DOUBLE) AS confidence FROM pages""")
def asset_roles(spark, sf):
    """Roles by ordered overrides over urls taken as paths; the SQL has what the rules make of these three, table-driven tests cover each branch."""
    p = table(spark, sf, "pages").withColumn("p", F.concat(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), F.when(F.col("page_id") % 3 == 0, "/final/report.docx").when(F.col("page_id") % 3 == 1, "/old/raw/data.csv").otherwise("/readme.md")))
    return p.select("page_id", paths.asset_role(F.col("p"), paths.extension(F.col("p"))).alias("r")).select("page_id", "r.*")


@query(ENTRY_SQL + """, s AS (SELECT path FROM e WHERE page_id % 2 = 0 UNION SELECT concat('none/', CAST(page_id AS VARCHAR)) FROM e WHERE page_id % 50 = 0), i AS (SELECT path, min(sha256) AS sha256, min(hash_status) AS hash_status FROM e WHERE entry_kind = 'file' GROUP BY 1)
SELECT s.path, i.sha256, CASE WHEN i.path IS NULL THEN 'NOT_IN_INVENTORY' WHEN hash_status <> 'PASS' THEN 'HASH_NOT_AUDITED' ELSE 'SELECTED' END AS selection_state FROM s LEFT JOIN i ON s.path = i.path""")
def selection_join_inventory(spark, sf):
    from ledgerlake.operators.gates import select_inventory

    e = entries(spark, sf)
    want = e.where("page_id % 2 = 0").select("path").union(e.where("page_id % 50 = 0").select(F.concat(F.lit("none/"), F.col("page_id").cast("string")))).distinct()
    have = e.where("entry_kind = 'file'").groupBy("path").agg(F.min("sha256").alias("sha256"), F.min("hash_status").alias("hash_status"))
    return select_inventory(want, have)
