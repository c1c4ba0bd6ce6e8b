"""Handoffs, field mappings, contracts and audits. customers stand for handoffs, their orders for records, lineitem for stages and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions import checks, paths, text
from ledgerlake.operators import audit, contracts, gates, graphs, grids, handoff

from .evidence import EDGE_SQL, FIELD_SQL, SOURCE, TARGET, field, nation_edges
from .registry import query, table
from .texts import ENTRY_SQL, LABEL_SQL, LINES_SQL, PLAIN, _findings_sql, doc_lines, entries, labelled

NONE_SQL = "CAST([] AS VARCHAR[])"
AUDIT_SQL = f"""
WITH a AS (SELECT c_custkey AS handoff_id, CASE c_nationkey % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'SKIPPED' ELSE 'FAIL' END AS s, CASE c_nationkey % 4 WHEN 0 THEN {NONE_SQL} WHEN 1 THEN ['BROKEN_LINK', 'SYMLINK_BOUNDARY'] WHEN 2 THEN ['NOT_RUN'] ELSE ['PERMISSION_DENIED'] END AS r FROM customer),
v AS (SELECT c_custkey AS handoff_id, CASE c_custkey % 6 WHEN 0 THEN 'rejected' WHEN 1 THEN 'maybe' ELSE 'accepted' END AS decision, c_custkey % 7 <> 0 AS human, CASE WHEN c_custkey % 5 = 0 THEN ['BROKEN_LINK'] ELSE ['BROKEN_LINK', 'SYMLINK_BOUNDARY', 'NOT_RUN'] END AS reviewed, c_custkey % 3 <> 0 AS accepted, c_custkey % 11 = 0 AS blocked FROM customer WHERE c_custkey % 2 = 0),
w AS (SELECT handoff_id, s, r, human AND decision IN ('accepted', 'rejected') AS valid, decision, blocked, (s = 'PARTIAL' AND NOT accepted) OR len(list_filter(r, lambda x: NOT list_contains(reviewed, x))) > 0 AS inc FROM a JOIN v USING (handoff_id)),
z AS (SELECT handoff_id, valid, CASE WHEN NOT valid THEN NULL WHEN s = 'FAIL' THEN 'FAIL' WHEN s = 'SKIPPED' THEN 'PARTIAL' WHEN decision = 'rejected' OR blocked THEN 'FAIL' WHEN inc THEN 'PARTIAL' ELSE 'PASS' END AS status,
 CASE WHEN NOT valid THEN {NONE_SQL} WHEN s = 'FAIL' THEN list_append(r, 'UPSTREAM_AUDIT_FAILED') WHEN s = 'SKIPPED' THEN list_append(r, 'UPSTREAM_AUDIT_INCOMPLETE') WHEN decision = 'rejected' AND blocked THEN ['SCOPE_REVIEW_REJECTED'] WHEN decision = 'rejected' THEN ['SCOPE_REVIEW_REJECTED', 'SCOPE_REVIEW_INCOMPLETE']
 WHEN blocked THEN ['SCOPE_REVIEW_HAS_BLOCKED_ITEMS'] WHEN inc THEN ['SCOPE_REVIEW_INCOMPLETE'] ELSE {NONE_SQL} END AS reason_codes FROM w)
"""


def _list(*names: str):
    return F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")


def audits(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("c_nationkey") % 4
    status = F.when(n == 0, "PASS").when(n == 1, "PARTIAL").when(n == 2, "SKIPPED").otherwise("FAIL")
    codes = F.when(n == 0, _list()).when(n == 1, _list("BROKEN_LINK", "SYMLINK_BOUNDARY")).when(n == 2, _list("NOT_RUN")).otherwise(_list("PERMISSION_DENIED"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("handoff_id"), status.alias("status"), codes.alias("reason_codes"))


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    some = lambda c, *names: F.when(c, _list(*names)).otherwise(_list())
    return handoff.scope_reviews(table(spark, sf, "customer").where("c_custkey % 2 = 0").select(
        k.alias("handoff_id"), F.when(k % 6 == 0, "rejected").when(k % 6 == 1, "maybe").otherwise("accepted").alias("decision"), F.when(k % 7 == 0, "Review-Agent").otherwise("lead engineer").alias("reviewer_role"),
        F.when(k % 5 == 0, _list("BROKEN_LINK")).otherwise(_list("BROKEN_LINK", "SYMLINK_BOUNDARY", "NOT_RUN")).alias("reviewed"), some(k % 3 != 0, "old scans").alias("accepted"), some(k % 11 == 0, "item").alias("blocked"),
    ), audits(spark, sf))


@query(AUDIT_SQL + "SELECT handoff_id, status, reason_codes, valid FROM z")
def scope_review(spark, sf):
    return reviews(spark, sf)


AUDIT_STATE_SQL = AUDIT_SQL + f""", ast AS (SELECT a.handoff_id, CASE WHEN a.s IN ('PASS', 'FAIL') THEN a.s WHEN z.valid THEN z.status ELSE 'PARTIAL' END AS status,
 CASE WHEN a.s = 'PASS' THEN {NONE_SQL} WHEN a.s = 'FAIL' THEN list_append(a.r, 'UPSTREAM_AUDIT_FAILED') WHEN z.valid THEN z.reason_codes ELSE list_append(a.r, 'UPSTREAM_AUDIT_INCOMPLETE') END AS reason_codes FROM a LEFT JOIN z USING (handoff_id))
"""


@query(AUDIT_STATE_SQL + "SELECT handoff_id, status, reason_codes FROM ast")
def audit_readiness(spark, sf):
    return handoff.audit_states(audits(spark, sf), reviews(spark, sf))


READY_SQL = AUDIT_STATE_SQL + f""", o AS (SELECT o_custkey AS handoff_id, o_orderkey AS artifact_id, CASE o_orderkey % 7 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'SKIPPED' ELSE 'PASS' END AS s, o_orderkey % 3 = 0 AS coded FROM orders),
ox AS (SELECT handoff_id, artifact_id AS ord, s, CASE WHEN coded THEN concat('CODE_', artifact_id % 4) WHEN s = 'FAIL' THEN 'UPSTREAM_OUTPUT_FAILED' ELSE 'UPSTREAM_OUTPUT_INCOMPLETE' END AS code FROM o WHERE s <> 'PASS'),
os AS (SELECT handoff_id, CASE WHEN count(*) FILTER (s = 'FAIL') > 0 THEN 'FAIL' ELSE 'PARTIAL' END AS status FROM ox GROUP BY 1),
oc AS (SELECT ox.handoff_id, code, min(ord) AS m FROM ox JOIN os USING (handoff_id) WHERE (status = 'FAIL') = (s = 'FAIL') GROUP BY 1, 2),
ost AS (SELECT os.handoff_id, status, (SELECT list(code ORDER BY m) FROM oc WHERE oc.handoff_id = os.handoff_id) AS reason_codes FROM os)
"""


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("handoff_id"), k.alias("artifact_id"), F.when(k % 7 == 0, "FAIL").when(k % 7 == 1, "PARTIAL").when(k % 7 == 2, "SKIPPED").otherwise("PASS").alias("status"), F.when(k % 3 == 0, F.array(F.concat(F.lit("CODE_"), (k % 4).cast("string")))).otherwise(_list()).alias("reason_codes"))
    return handoff.output_states(o)


@query(READY_SQL + "SELECT handoff_id, status, reason_codes FROM ost")
def output_readiness(spark, sf):
    return outputs(spark, sf)


@query("""WITH d AS (SELECT l_orderkey AS handoff_id, l_linenumber AS dependency_id, CASE WHEN l_quantity > 45 THEN 'FAIL' WHEN l_quantity > 40 THEN 'SKIPPED' ELSE 'PASS' END AS s FROM lineitem WHERE l_returnflag = 'N'),
x AS (SELECT handoff_id, count(*) FILTER (s = 'FAIL') AS f FROM d WHERE s <> 'PASS' GROUP BY 1) SELECT handoff_id, CASE WHEN f > 0 THEN 'FAIL' ELSE 'PARTIAL' END AS status, CASE WHEN f > 0 THEN ['PRIVATE_DEPENDENCY_MISSING'] ELSE ['PRIVATE_DEPENDENCY_UNVERIFIED'] END AS reason_codes FROM x""")
def dependency_readiness(spark, sf):
    q = F.col("l_quantity")
    return handoff.dependency_states(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("handoff_id"), F.col("l_linenumber").alias("dependency_id"), (F.col("l_returnflag") == "N").alias("required"), F.when(q > 45, "FAIL").when(q > 40, "SKIPPED").otherwise("PASS").alias("availability_status"), _list().alias("reason_codes")))


REGRESSION_SQL = f"""
g AS (SELECT o_custkey AS handoff_id, o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 'FAIL' WHEN o_orderkey % 5 = 1 THEN 'PARTIAL' ELSE 'PASS' END AS st, CASE WHEN o_orderkey % 9 = 0 THEN 'UNAUTHORIZED_REGRESSION_RECORD' WHEN o_orderkey % 5 = 1 THEN 'REGRESSION_RECORD_INCOMPLETE' END AS code FROM orders),
gs AS (SELECT handoff_id, count(*) FILTER (st = 'FAIL') AS f, count(*) FILTER (st = 'PARTIAL') AS p FROM g GROUP BY 1),
rst AS (SELECT c_custkey AS handoff_id, CASE WHEN f > 0 THEN 'FAIL' WHEN p > 0 THEN 'PARTIAL' WHEN gs.handoff_id IS NULL AND c_custkey % 2 = 0 THEN 'PARTIAL' ELSE 'PASS' END AS status,
 CASE WHEN f > 0 THEN ['UNAUTHORIZED_REGRESSION_RECORD'] WHEN p > 0 THEN ['REGRESSION_RECORD_INCOMPLETE'] WHEN gs.handoff_id IS NULL AND c_custkey % 2 = 0 THEN ['MISSING_REGRESSION_RECORD'] ELSE {NONE_SQL} END AS reason_codes FROM customer LEFT JOIN gs ON gs.handoff_id = c_custkey)
"""


def regressions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    r = table(spark, sf, "orders").select(F.col("o_custkey").alias("handoff_id"), k.alias("regression_id"), F.lit("PASS").alias("status"), _list().alias("reason_codes"), (k % 9 != 0).alias("authorized"), F.when(k % 5 != 1, 0).alias("exit_code"), F.col("o_orderdate").alias("executed_at"), F.lit("ref").alias("actual_ref"))
    return handoff.regression_states(r, table(spark, sf, "customer").select(F.col("c_custkey").alias("handoff_id"), (F.col("c_custkey") % 2 == 0).alias("require_regression")))


@query("WITH " + REGRESSION_SQL + "SELECT handoff_id, status, reason_codes FROM rst")
def regression_readiness(spark, sf):
    return regressions(spark, sf)


@query(READY_SQL + ", " + REGRESSION_SQL + f""", u AS (SELECT *, 0 AS o FROM ast UNION ALL SELECT *, 1 FROM rst UNION ALL SELECT *, 2 FROM ost), q AS (SELECT handoff_id, count(*) FILTER (status = 'FAIL') AS f, count(*) FILTER (status = 'PARTIAL') AS p FROM u GROUP BY 1),
e AS (SELECT handoff_id, status, o, unnest(reason_codes) AS code, unnest(range(len(reason_codes))) AS i FROM u), ec AS (SELECT e.handoff_id, code, min(o * 1000000 + i) AS m FROM e JOIN q USING (handoff_id) WHERE status = CASE WHEN f > 0 THEN 'FAIL' ELSE 'PARTIAL' END GROUP BY 1, 2), el AS (SELECT handoff_id, list(code ORDER BY m) AS reason_codes FROM ec GROUP BY 1)
SELECT q.handoff_id, CASE WHEN f > 0 THEN 'FAIL' WHEN p > 0 THEN 'PARTIAL' ELSE 'PASS' END AS status, coalesce(el.reason_codes, {NONE_SQL}) AS reason_codes FROM q LEFT JOIN el USING (handoff_id)""")
def handoff_readiness(spark, sf):
    return handoff.readiness(handoff.audit_states(audits(spark, sf), reviews(spark, sf)), regressions(spark, sf), outputs(spark, sf))


@query(f"""WITH a AS (SELECT source AS handoff_id, doc_id, sha256(text) AS h, doc_id % 10 = 0 AS ext FROM documents), p AS (SELECT source, doc_id, CASE WHEN doc_id % 97 = 0 THEN sha256(concat(text, '!')) ELSE upper(sha256(text)) END AS f FROM documents WHERE doc_id % 101 <> 1),
s AS (SELECT a.handoff_id, 0 AS part, CAST(a.doc_id AS VARCHAR) AS ord, CASE WHEN ext THEN 'PARTIAL' WHEN p.f IS NULL OR lower(p.f) <> h THEN 'FAIL' ELSE 'PASS' END AS st, CASE WHEN ext THEN 'EXTERNAL_ARTIFACT_NOT_RESOLVED' WHEN p.f IS NULL THEN 'MISSING_REQUIRED_FILE' WHEN lower(p.f) <> h THEN 'HASH_MISMATCH' END AS code FROM a LEFT JOIN p USING (doc_id)
UNION ALL SELECT a.handoff_id, 1, CAST(a.doc_id AS VARCHAR), CASE WHEN a.doc_id % 8 = 0 THEN 'PARTIAL' WHEN p.doc_id IS NULL THEN 'FAIL' END, CASE WHEN a.doc_id % 8 = 0 THEN 'EXTERNAL_ENTRYPOINT_NOT_RESOLVED' ELSE 'MISSING_ENTRYPOINT' END FROM a LEFT JOIN p USING (doc_id) WHERE a.doc_id % 4 = 0 OR a.doc_id % 101 = 1),
q AS (SELECT handoff_id, count(*) FILTER (st = 'FAIL') AS f, count(*) FILTER (st = 'PARTIAL') AS p FROM s GROUP BY 1), c AS (SELECT s.handoff_id, code, min((part, ord)) AS m FROM s JOIN q USING (handoff_id) WHERE st = CASE WHEN f > 0 THEN 'FAIL' ELSE 'PARTIAL' END GROUP BY 1, 2), l AS (SELECT handoff_id, list(code ORDER BY m) AS reason_codes FROM c GROUP BY 1)
SELECT q.handoff_id, CASE WHEN f > 0 THEN 'FAIL' WHEN p > 0 THEN 'PARTIAL' ELSE 'PASS' END AS status, coalesce(l.reason_codes, {NONE_SQL}) AS reason_codes FROM q LEFT JOIN l USING (handoff_id)""")
def package_states(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("handoff_id"), "doc_id", F.col("doc_id").cast("string").alias("path"), "text")
    k, sha = F.col("doc_id"), F.sha2("text", 256)
    a = d.select("handoff_id", k.alias("ord"), "path", sha.alias("sha256"), (k % 10 == 0).alias("external"))
    e = d.where("doc_id % 4 = 0 or doc_id % 101 = 1").select("handoff_id", k.alias("ord"), "path", (k % 8 == 0).alias("external"))
    have = d.where("doc_id % 101 <> 1").select("handoff_id", "path", F.when(k % 97 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.upper(sha)).alias("sha256"))
    none = spark.createDataFrame([], "handoff_id string, ord string, status string, reason_codes array<string>")
    return handoff.package_states(a, e, have, none)


# Fields


@query(f"""WITH r AS (SELECT p_partkey AS mapping_id, CASE WHEN p_size % 5 = 0 THEN 'nearest' ELSE 'area-overlap-piecewise-constant' END AS m, CASE WHEN p_size % 7 = 0 THEN 'extrapolate' ELSE 'reject' END AS o, CASE WHEN p_size % 11 = 0 THEN 'zero' ELSE 'reject' END AS v, CASE WHEN p_size % 13 = 0 THEN 'triangles' ELSE 'regular_2d' END AS g FROM part),
c AS (SELECT mapping_id, list_filter([CASE WHEN m = 'nearest' THEN 'UNSUPPORTED_MAPPING_METHOD' END, CASE WHEN o <> 'reject' THEN 'UNSUPPORTED_OUTSIDE_DOMAIN_POLICY' END, CASE WHEN v <> 'reject' THEN 'UNSUPPORTED_MISSING_VALUE_POLICY' END, CASE WHEN g <> 'regular_2d' THEN 'UNSUPPORTED_GRID_TYPE' END], lambda x: x IS NOT NULL) AS reason_codes FROM r)
SELECT mapping_id, CASE WHEN len(reason_codes) > 0 THEN 'SKIPPED' END AS status, reason_codes FROM c""")
def mapping_support(spark, sf):
    n = F.col("p_size")
    pick = lambda k, odd, plain: F.when(n % k == 0, odd).otherwise(plain)
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("mapping_id"), pick(5, "nearest", handoff.MAPPING_METHOD).alias("method"), pick(7, "extrapolate", "reject").alias("outside_domain_policy"), pick(11, "zero", "reject").alias("missing_value_policy"), F.array(pick(13, "triangles", "regular_2d"), F.lit("regular_2d")).alias("grid_types"), _list("cell", "cell").alias("centerings"))
    return handoff.mapping_support(p)


@query(f"""WITH s AS (SELECT p_partkey AS mapping_id, list_concat(list_concat(CASE WHEN p_size % 5 = 0 THEN ['UNSUPPORTED_FIELD_RANK'] ELSE {NONE_SQL} END, list_filter([CASE WHEN p_size % 6 = 0 THEN 'SOURCE_HASH_MISMATCH' END, CASE WHEN p_size % 7 = 0 THEN 'AXIS_ORDER_MISMATCH' END, CASE WHEN p_size % 8 = 0 THEN 'FIELD_UNIT_MISMATCH' END, CASE WHEN p_size % 9 = 0 THEN 'SIGN_CONVENTION_MISMATCH' END, CASE WHEN p_size % 10 = 0 THEN 'FIELD_COMPONENT_COLUMN_MISMATCH' END], lambda x: x IS NOT NULL)), CASE WHEN p_size % 11 = 0 THEN ['MISSING_VALUE'] ELSE {NONE_SQL} END) AS reason_codes FROM part)
SELECT mapping_id, CASE WHEN len(reason_codes) = 0 THEN 'PASS' WHEN reason_codes = ['UNSUPPORTED_FIELD_RANK'] THEN 'SKIPPED' ELSE 'FAIL' END AS status, reason_codes FROM s""")
def input_identity(spark, sf):
    n = F.col("p_size")
    pick = lambda k, odd, plain: F.when(n % k == 0, odd).otherwise(plain)
    some = lambda k, code: F.when(n % k == 0, _list(code)).otherwise(_list())
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("mapping_id"), pick(6, "AB", "ab").alias("actual_sha256"), pick(6, "cd", "AB").alias("expected_sha256"), F.when(n % 7 == 0, _list("y", "x")).otherwise(_list("x", "y")).alias("columns"), _list("x", "y").alias("axis_order"),
        pick(8, "K", "Pa").alias("source_units"), F.lit("Pa").alias("target_units"), pick(9, "in", "out").alias("source_sign"), F.lit("out").alias("target_sign"), pick(10, "u", "p").alias("component"), F.lit("p").alias("value_column"), some(11, "MISSING_VALUE").alias("table_codes"), some(5, "UNSUPPORTED_FIELD_RANK").alias("unsupported"),
    )
    return handoff.input_identity(p)


@query(FIELD_SQL + """, t AS (SELECT l_orderkey % 3 AS turn, 2.0 * round(l_discount * 100) + 3 + CASE WHEN l_orderkey % 3 = 1 THEN 0.5 ELSE 0 END AS x, -0.5 * CAST(l_quantity AS INT) + 1 AS y FROM lineitem), g AS (SELECT turn, count(*) FILTER (x NOT IN (SELECT 3.0 + 2 * range FROM range(11))) + count(*) FILTER (y NOT IN (SELECT -24.0 + 0.5 * range FROM range(50))) AS off FROM t GROUP BY 1)
SELECT turn, CASE WHEN off > 0 THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN off > 0 THEN ['COORDINATE_TRANSFORM_MISMATCH'] ELSE CAST([] AS VARCHAR[]) END AS reason_codes FROM g""")
def grid_normalize_status(spark, sf):
    """Whether all that a transform makes lies on the grid that it declares; one of three transforms misses it."""
    out = grids.Grid((11, 50), (2.0, 0.5), (2.0, -24.25))
    li = table(spark, sf, "lineitem")
    f = li.select((F.col("l_orderkey") % 3).alias("turn"), F.col("l_quantity").cast("int").cast("double").alias("x"), F.round(F.col("l_discount") * 100).alias("y")).distinct()
    parts = [grids.normalize_status(f.where(F.col("turn") == t), (1, 0), (2.0, -0.5), (3.5 if t == 1 else 3.0, 1.0), out).withColumn("turn", F.lit(t).cast("long")) for t in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("turn", "status", "reason_codes")


@query(FIELD_SQL + """, n AS (SELECT count(*) AS cells FROM f), c AS (SELECT sum(coverage) / 320 AS coverage FROM r)
SELECT 'whole' AS name, CASE WHEN cells < 550 THEN 'FAIL' WHEN coverage >= 0.999 THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN cells < 550 THEN ['GRID_SHAPE_MISMATCH', 'COORDINATE_LOOKUP_FAILED'] WHEN coverage >= 0.999 THEN CAST([] AS VARCHAR[]) ELSE ['COVERAGE_CRITERION_NOT_MET'] END AS reason_codes FROM n, c
UNION ALL SELECT 'elsewhere', 'FAIL', CASE WHEN cells < 550 THEN ['GRID_SHAPE_MISMATCH', 'COORDINATE_LOOKUP_FAILED', 'TARGET_DOMAIN_MISMATCH'] ELSE ['TARGET_DOMAIN_MISMATCH'] END FROM n""")
def grid_regrid_status(spark, sf):
    f = field(spark, sf)
    a = grids.regrid_status(f, SOURCE, TARGET, "gte", 0.999).withColumn("name", F.lit("whole"))
    b = grids.regrid_status(f, SOURCE, grids.Grid((40, 8), (1.25, 1.375), (1.5, -0.5)), "gte", 0.999).withColumn("name", F.lit("elsewhere"))
    return a.unionByName(b).select("name", "status", "reason_codes")


MANIFEST_SQL = """
WITH s AS (SELECT l_orderkey AS mapping_id, l_linenumber AS gate_id, CASE WHEN l_quantity > 40 THEN 'FAIL' ELSE 'PASS' END AS st FROM lineitem GROUP BY ALL), q AS (SELECT mapping_id, count(*) AS n, count(*) FILTER (st <> 'PASS') AS bad, count(*) FILTER (mapping_id % 13 = 0 AND gate_id = 2) AS lost FROM s GROUP BY 1),
x AS (SELECT o_orderkey AS mapping_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'h' END AS h, CASE WHEN o_orderkey % 5 = 0 THEN 'other' ELSE 'h' END AS rep FROM orders),
y AS (SELECT mapping_id, CASE WHEN coalesce(n, 0) <> 4 OR bad > 0 THEN 'STAGE_NOT_PASSED' WHEN lost > 0 THEN 'STAGE_GATE_MISSING' WHEN h IS NOT NULL AND h <> rep THEN 'OUTPUT_HASH_MISMATCH' END AS reason FROM x LEFT JOIN q USING (mapping_id))
"""


@query(MANIFEST_SQL + "SELECT mapping_id, reason IS NULL AS released, reason FROM y")
def manifest_release(spark, sf):
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("mapping_id"), F.col("l_linenumber").alias("gate_id"), F.when(F.col("l_quantity") > 40, "FAIL").otherwise("PASS").alias("status")).distinct()
    k = F.col("o_orderkey")
    m = table(spark, sf, "orders").select(k.alias("mapping_id"), F.when(k % 4 != 0, "h").alias("output_sha256"), F.when(k % 5 == 0, "other").otherwise("h").alias("reported_sha256"))
    return handoff.manifest_release(m, s, s.where("not (mapping_id % 13 = 0 and gate_id = 2)").select("mapping_id", "gate_id"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS g, l_linenumber AS v FROM lineitem), f AS (SELECT DISTINCT l_orderkey AS g, l_linenumber AS v FROM lineitem WHERE l_quantity <= 48) SELECT e.g AS report, count(*) FILTER (f.v IS NULL) = 0 AS covered FROM e LEFT JOIN f ON e.g = f.g AND e.v = f.v GROUP BY 1""")
def gates_covered(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("report"), F.col("l_linenumber").alias("gate_id"), "l_quantity")
    return contracts.covers(li.select("report", "gate_id").distinct(), li.where("l_quantity <= 48"), "report", "gate_id")


# Contracts and paths


@query("""SELECT o_orderkey, o_custkey, 'UNKNOWN_REFERENCE' AS violation FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
""")
def dangling_references(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey"))
    return contracts.dangling(o, table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"]).select("o_orderkey", "o_custkey", "violation")


@query("SELECT l_orderkey, l_suppkey, count(*) AS n, 'REPEATED_VALUE' AS violation FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_values(spark, sf):
    return contracts.repeated(table(spark, sf, "lineitem"), ["l_orderkey"], "l_suppkey")


@query("""WITH r AS (SELECT page_id, list_filter(['id', CASE WHEN page_id % 3 <> 0 THEN 'status' END, CASE WHEN page_id % 5 = 0 THEN 'notes' END, CASE WHEN page_id % 7 = 0 THEN 'extra' END], lambda x: x IS NOT NULL) AS k FROM pages)
SELECT page_id, 'MISSING_KEY' AS violation, 'status' AS key FROM r WHERE NOT list_contains(k, 'status') UNION ALL SELECT page_id, 'UNKNOWN_KEY', 'extra' FROM r WHERE list_contains(k, 'extra')""")
def key_violations(spark, sf):
    k = F.col("page_id")
    keys = F.filter(F.array(F.lit("id"), F.when(k % 3 != 0, "status"), F.when(k % 5 == 0, "notes"), F.when(k % 7 == 0, "extra")), lambda x: x.isNotNull())
    return contracts.key_violations(table(spark, sf, "pages").select("page_id", keys.alias("k")), "page_id", "k", ["id", "status"], ["notes"])


PATHS = ["%s", "/%s", "C:/%s", "../%s", "a//%s", "./%s", "%s/..", "a\\\\%s", "", "%s/*"]
PATH_SQL = r"""
WITH v AS (SELECT page_id, CASE page_id % 10 WHEN 0 THEN n WHEN 1 THEN '/' || n WHEN 2 THEN 'C:/' || n WHEN 3 THEN '../' || n WHEN 4 THEN 'a//' || n WHEN 5 THEN './' || n WHEN 6 THEN n || '/..' WHEN 7 THEN 'a\' || n WHEN 8 THEN '' ELSE n || '/*' END AS p, page_id % 10 AS k FROM (SELECT page_id, 'd' || page_id AS n FROM pages))
"""


@query(PATH_SQL + r"""SELECT page_id, k IN (0, 4, 5, 7, 9) AS reference, k IN (0, 7, 9) AS glob, k = 0 AS folder, CASE k WHEN 0 THEN p WHEN 4 THEN replace(p, '//', '/') WHEN 5 THEN substr(p, 3) WHEN 7 THEN replace(p, '\', '/') WHEN 9 THEN p END AS portable FROM v""")
def path_predicates(spark, sf):
    k, n = F.col("page_id") % 10, F.concat(F.lit("d"), F.col("page_id").cast("string"))
    forms = [n, F.concat(F.lit("/"), n), F.concat(F.lit("C:/"), n), F.concat(F.lit("../"), n), F.concat(F.lit("a//"), n), F.concat(F.lit("./"), n), F.concat(n, F.lit("/..")), F.concat(F.lit("a\\"), n), F.lit(""), F.concat(n, F.lit("/*"))]
    p = table(spark, sf, "pages").select("page_id", F.element_at(F.array(*forms), (k + 1).cast("int")).alias("p"))
    c = F.col("p")
    return p.select("page_id", paths.safe_reference(c).alias("reference"), paths.safe_glob(c).alias("glob"), paths.folder_name(c).alias("folder"), paths.portable(c).alias("portable"))


@query(ENTRY_SQL + """SELECT page_id, CASE WHEN regexp_matches(path, '(^|[^a-z0-9])(gate|checkpoint|iteration|iter|phase|stage|validation|verify|audit)([^a-z0-9]|$)') THEN 'GATE_LOCAL' WHEN page_id % 3 = 0 THEN 'WORKSTREAM_LOCAL' WHEN page_id % 5 = 0 THEN 'PROJECT_WIDE' ELSE 'FILE_LOCAL' END AS authority_scope
FROM (SELECT page_id, lower(concat(path, CASE WHEN page_id % 7 = 0 THEN '/phase_2' ELSE '' END)) AS path FROM e)""")
def authority_scope(spark, sf):
    k = F.col("page_id")
    e = entries(spark, sf).select("page_id", F.concat("path", F.when(k % 7 == 0, "/phase_2").otherwise("")).alias("path"))
    return e.select("page_id", paths.authority_scope(F.col("path"), F.when(k % 3 == 0, "w"), F.when(k % 5 == 0, "README.md").otherwise("a/b.md")).alias("authority_scope"))


@query(r"""SELECT doc_id, CASE WHEN s < 1024 THEN printf('%.1f B', s) WHEN s < 1048576 THEN printf('%.1f KiB', s / 1024) WHEN s < 1073741824 THEN printf('%.1f MiB', s / 1048576) WHEN s < 1099511627776 THEN printf('%.1f GiB', s / 1073741824) ELSE printf('%.1f TiB', s / 1099511627776) END AS size,
 replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html, replace(regexp_replace(t, '\r\n|\r|\n', ' ', 'g'), '|', '\|') AS cell FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) * pow(2, doc_id % 40) AS s, coalesce(text, '') AS t FROM documents)""")
def sizes_and_escapes(spark, sf):
    d, t = table(spark, sf, "documents"), F.col("text")
    return d.select("doc_id", text.human_size(F.col("n_chars") * F.pow(F.lit(2.0), F.col("doc_id") % 40)).alias("size"), text.html_escaped(t).alias("html"), text.markdown_escaped(t).alias("cell"))


@query(LINES_SQL + r"SELECT doc_id, line_no, unnest(list_distinct(regexp_extract_all(line, '([a-z0-9]{3,}\.(?:md|txt|csv|pdf))\b', 1))) AS name FROM (SELECT doc_id, line_no, concat('see file', doc_id, '.csv, file', doc_id, '.csv or r', line_no, '.md (notes.exe) ') AS line FROM li)")
def file_names_in_prose(spark, sf):
    li = doc_lines(spark, sf).select("doc_id", "line_no", F.concat(F.lit("see file"), F.col("doc_id").cast("string"), F.lit(".csv, file"), F.col("doc_id").cast("string"), F.lit(".csv or r"), F.col("line_no").cast("string"), F.lit(".md (notes.exe) ")).alias("line"))
    return text.file_names_in(li, "doc_id")


@query("""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+02:00') WHEN 3 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M') END AS v, CAST(o_orderdate AS TIMESTAMP) AS t FROM orders)
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN NULL WHEN 2 THEN strftime(t - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(t, '%Y-%m-%dT%H:%M:%SZ') END AS at FROM s""")
def iso_times(spark, sf):
    """Written and read in the session's zone, which the driver and the tests set to UTC."""
    k, t = F.col("o_orderkey") % 5, F.col("o_orderdate")
    form = lambda f: F.date_format(t, f)
    v = F.when(k == 0, form("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, form("yyyy-MM-dd")).when(k == 2, form("yyyy-MM-dd'T'HH:mm:ss'+02:00'")).when(k == 3, "soon").otherwise(form("yyyy-MM-dd HH:mm"))
    return table(spark, sf, "orders").select("o_orderkey", text.iso_text(text.iso_time(v)).alias("at"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN 'ERROR' ELSE CAST(CASE o_orderkey % 7 WHEN 0 THEN p < 100000 WHEN 1 THEN p <= 100000 WHEN 2 THEN p = 100000 WHEN 3 THEN p >= 100000 WHEN 4 THEN p > 100000 ELSE p BETWEEN 100000 AND 200000 END AS VARCHAR) END AS result FROM (SELECT o_orderkey, o_totalprice AS p FROM orders)""")
def declared_criteria(spark, sf):
    k, p = F.col("o_orderkey") % 7, F.col("o_totalprice")
    op = F.element_at(F.array(*[F.lit(x) for x in ("lt", "lte", "eq", "gte", "gt", "between", "near")]), (k + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", checks.compare_declared(p, op, F.lit(100_000.0), F.lit(200_000.0)).alias("result"))


# Audits


@query(ENTRY_SQL + """, c AS (SELECT page_id, path, entry_kind, list_has_any(string_split(lower(path), '/'), ['es']) AS env, contains(lower(path), 'en/1') AS inc, contains(lower(path), '/de/') AS exc, regexp_matches(lower(path), '2$') AS pri FROM e)
SELECT page_id, CASE WHEN exc THEN 'excluded' WHEN inc THEN 'included' ELSE 'neutral' END AS scope, pri AS priority, CASE WHEN env THEN 'environment' END AS role, entry_kind = 'file' AND NOT exc AND NOT env AND (inc OR pri) AS "primary",
 list_filter([CASE WHEN inc THEN 'profile-include-rule' END, CASE WHEN exc THEN 'profile-exclude-rule' END, CASE WHEN pri THEN 'profile-priority-path' END, CASE WHEN env THEN 'profile-environment-folder' END], lambda x: x IS NOT NULL) AS basis FROM c""")
def profile_contexts(spark, sf):
    profile = {"include": ["*EN/1*"], "exclude": ["*/de/*"], "priority": ["*2"], "environment": ["ES"]}
    return entries(spark, sf).select("page_id", audit.profile_context(F.col("path"), F.col("entry_kind"), profile).alias("c")).select("page_id", "c.*")


@query(LABEL_SQL + "SELECT e.page_id, e.path, e.sha256, m.label FROM e LEFT JOIN (SELECT path, min(label) AS label FROM c JOIN e USING (page_id) WHERE c.page_id % 3 <> 0 GROUP BY 1) m ON m.path = e.path")
def inventory_with_labels(spark, sf):
    e = entries(spark, sf)
    la = labelled(spark, sf).where("page_id % 3 <> 0").join(e.select("page_id", "path"), "page_id").groupBy("path").agg(F.min("label").alias("label"))
    return audit.with_labels(e.select("page_id", "path", "sha256"), la)


REASON_SQL = ENTRY_SQL + """, x AS (SELECT *, CASE page_id % 12 WHEN 0 THEN 'BROKEN_LINK;SYMLINK_BOUNDARY' WHEN 1 THEN 'PERMISSION_DENIED' WHEN 2 THEN 'JUNCTION_BOUNDARY' WHEN 3 THEN NULL WHEN 4 THEN 'HASH_READ_FAILED;ENTRY_STAT_FAILED' ELSE '' END AS rc FROM e)
"""


def reasoned(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id") % 12
    return entries(spark, sf).withColumn("reason_codes", F.when(k == 0, "BROKEN_LINK;SYMLINK_BOUNDARY").when(k == 1, "PERMISSION_DENIED").when(k == 2, "JUNCTION_BOUNDARY").when(k == 4, "HASH_READ_FAILED;ENTRY_STAT_FAILED").when(k != 3, ""))


@query(REASON_SQL + """SELECT 'BROKEN_LINK' AS risk_type, 'high' AS severity, [path] AS relative_paths FROM x WHERE rc LIKE 'BROKEN%' UNION ALL SELECT 'LINK_BOUNDARY', 'medium', [path] FROM x WHERE rc LIKE '%BOUNDARY' UNION ALL SELECT 'SCAN_INCOMPLETE', 'high', [path] FROM x WHERE rc LIKE 'PERM%' OR rc LIKE 'HASH%'""")
def entry_risks(spark, sf):
    return audit.entry_risks(reasoned(spark, sf)).select("risk_type", "severity", "relative_paths")


ABSOLUTE = r"[A-Za-z]:[\\/][^\s\"'<>]+|/(?:home|Users|mnt|var|tmp)/[^\s\"'<>]+"


def _told(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    more = F.when(k % 9 == 0, "\nsee /home/x/y and C:\\data\\f\nno path").when(k % 9 == 1, "\n/opt/none").otherwise("")
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat("text", more).alias("text"))


TOLD_SQL = r"""
WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS path, concat(text, CASE doc_id % 9 WHEN 0 THEN concat(chr(10), 'see /home/x/y and C:\data\f', chr(10), 'no path') WHEN 1 THEN concat(chr(10), '/opt/none') ELSE '' END) AS text FROM documents),
u AS (SELECT path, string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM t), v AS (SELECT path, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS no FROM u),
h AS (SELECT path, list_sort(list(no)) AS line_numbers FROM v WHERE regexp_matches(line, '[A-Za-z]:[\\/][^\s"''<>]+|/(?:home|Users|mnt|var|tmp)/[^\s"''<>]+') GROUP BY 1)
"""


@query(TOLD_SQL + "SELECT path, line_numbers FROM h")
def absolute_path_lines(spark, sf):
    return audit.absolute_path_lines(_told(spark, sf), "path", "text", ABSOLUTE)


@query(REASON_SQL + ", " + TOLD_SQL.strip().removeprefix("WITH ") + """, lab AS (SELECT DISTINCT string_split(path, '/')[1] AS p FROM e WHERE list_contains(string_split(lower(path), '/'), 'de')),
dup AS (SELECT list_sort(list(lpad(CAST(page_id AS VARCHAR), 9, '0'))) AS p FROM e WHERE entry_kind = 'file' GROUP BY sha256 HAVING count(*) > 1),
r AS (SELECT 'DUPLICATE_CANDIDATE' AS t, p FROM dup UNION ALL SELECT 'LARGE_FILE', [path] FROM e WHERE entry_kind = 'file' AND size_bytes >= 6000 UNION ALL SELECT 'CACHE_DIRECTORY', [p] FROM lab
UNION ALL SELECT 'BROKEN_LINK', [path] FROM x WHERE rc LIKE 'BROKEN%' UNION ALL SELECT 'LINK_BOUNDARY', [path] FROM x WHERE rc LIKE '%BOUNDARY' UNION ALL SELECT 'SCAN_INCOMPLETE', [path] FROM x WHERE rc LIKE 'PERM%' OR rc LIKE 'HASH%'
UNION ALL SELECT 'EXPECTED_OUTPUT_NOT_CREATED', ['none/' || c_custkey] FROM customer UNION ALL SELECT 'CONTENT_SCAN_INCOMPLETE', [path] FROM t WHERE CAST(path AS INT) % 50 = 1 UNION ALL SELECT 'ABSOLUTE_PATH_REFERENCE', [path] FROM h
UNION ALL SELECT 'BROKEN_REFERENCE', ['m/' || doc_id || '.md'] FROM documents WHERE doc_id % 10 = 0),
n AS (SELECT t, p, row_number() OVER (ORDER BY t, p) AS n FROM r) SELECT t AS risk_type, p AS relative_paths, printf('RISK-%04d', n) AS risk_id FROM n""")
def risk_register_whole(spark, sf):
    """All ten types of risk in one register."""
    e, told = reasoned(spark, sf), _told(spark, sf)
    la = labelled(spark, sf).join(e.select("page_id", "path"), "page_id")
    want = table(spark, sf, "customer").select(F.concat(F.lit("none/"), F.col("c_custkey").cast("string")).alias("path"), (F.col("c_custkey") % 2 == 0).alias("required"))
    unread = told.select("path", F.when(F.col("path").cast("int") % 50 != 1, F.coalesce("text", F.lit(""))).alias("text"))
    md = table(spark, sf, "documents").select(F.concat(F.lit("m/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.when(F.col("doc_id") % 10 == 0, "[a](gone.md)").otherwise("[a](#x) [b](0.md)").alias("text"))
    known = md.select("path").union(spark.createDataFrame([("m/0.md",)], "path string")).distinct()
    dup = e.select(F.lpad(F.col("page_id").cast("string"), 9, "0").alias("path"), "entry_kind", "sha256")
    out = audit.register(
        audit.duplicate_risks(dup), audit.large_file_risks(e, 6000), audit.cache_risks(la), audit.entry_risks(e), audit.missing_output_risks(want, e), audit.unread_risks(unread),
        audit.absolute_path_risks(told, "path", "text", ABSOLUTE), audit.broken_reference_risks(md, known, "path", "text"),
    )
    return out.select("risk_type", "relative_paths", "risk_id")


@query(REASON_SQL + """, k AS (SELECT CASE WHEN list_contains(string_split(lower(path), '/'), 'de') THEN 1 ELSE 0 END AS cache FROM e), q AS (SELECT DISTINCT unnest(string_split(rc, ';')) AS c FROM x WHERE rc <> '')
SELECT (SELECT count(*) FROM x) AS inventory_entries, (SELECT count(*) FILTER (entry_kind = 'file') FROM x) AS files, (SELECT count(*) FILTER (entry_kind = 'directory') FROM x) AS directories, 0 AS link_boundaries, (SELECT list(c ORDER BY c) FROM q) AS reason_codes, (SELECT count(*) FILTER (cache = 0) FROM k) AS unknown, (SELECT count(*) FILTER (cache = 1) FROM k) AS cache,
 (SELECT count(*) FROM x WHERE rc <> '') + (SELECT count(*) FROM x WHERE rc LIKE 'BROKEN%') AS human_decisions, 'PARTIAL' AS status""")
def audit_rollup(spark, sf):
    e = reasoned(spark, sf)
    la = e.select("path", F.when(F.array_contains(F.split(F.lower("path"), "/"), "de"), "cache").otherwise("unknown").alias("label"))
    return audit.audit_rollup(e, la, audit.entry_risks(e))


@query(f"SELECT category, n, max(n) OVER () = 0 AS pass FROM (SELECT k.category, coalesce(sum(hits), 0) AS n FROM (SELECT unnest({list(PLAIN)!r}) AS category) k LEFT JOIN ({_findings_sql()}) f ON f.category = k.category GROUP BY 1)")
def privacy_verdict(spark, sf):
    return audit.finding_verdict(text.findings(doc_lines(spark, sf), "doc_id", PLAIN), list(PLAIN))


@query(EDGE_SQL + """, r AS (SELECT CAST(n_nationkey AS BIGINT) AS start, CAST(n_nationkey AS BIGINT) AS node FROM nation UNION SELECT r.start, e.dst FROM r JOIN e ON r.node = e.src), u AS (SELECT node, count(*) AS n FROM r GROUP BY 1)
SELECT coalesce(list(CAST(n_nationkey AS BIGINT) ORDER BY n_nationkey), CAST([] AS BIGINT[])) AS unreachable_nodes FROM nation JOIN u ON u.node = n_nationkey WHERE u.n < (SELECT count(*) FROM nation)""")
def unreachable_nodes(spark, sf):
    return graphs.unreachable(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("node")), nation_edges(spark, sf))


@query(EDGE_SQL + """, s AS (SELECT DISTINCT c_nationkey % 25 AS a, (c_nationkey + 1) % 25 AS b FROM customer), r AS (SELECT CAST(n_nationkey AS BIGINT) AS start, CAST(n_nationkey AS BIGINT) AS node FROM nation UNION SELECT r.start, e.dst FROM r JOIN e ON r.node = e.src),
p AS (SELECT CAST(n_nationkey AS BIGINT) AS src, CAST((n_nationkey * 3 + 1) % 25 AS BIGINT) AS dst FROM nation), q AS (SELECT count(*) FILTER (NOT EXISTS (SELECT 1 FROM r WHERE r.start = p.src AND r.node = p.dst)) AS lost FROM p), w AS (SELECT count(*) = (SELECT count(*) * count(*) FROM nation) AS ok FROM r)
SELECT 'all' AS check_id, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN ok THEN CAST([] AS VARCHAR[]) ELSE ['DISCONNECTED_TOPOLOGY'] END AS reason_codes FROM w UNION ALL SELECT 'pairs', CASE WHEN lost > 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN lost > 0 THEN CAST([] AS VARCHAR[]) ELSE ['UNEXPECTED_CONNECTED_TOPOLOGY'] END FROM q""")
def connectivity_gates(spark, sf):
    nodes, e = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("node")), nation_edges(spark, sf)
    n = F.col("node")
    every = graphs.all_connected(nodes, e, directed=True).select("connected")
    pairs = graphs.pairs_connected(e, nodes.select(n.alias("src"), ((n * 3 + 1) % 25).alias("dst"))).agg((F.count_if(~F.col("connected")) == 0).alias("connected"))
    gate = lambda df, name, expected: df.select(F.lit(name).alias("check_id"), *[c.alias(a) for c, a in zip(gates.connectivity_verdict(F.col("connected"), F.lit(expected)), ("status", "reason_codes"))])
    return gate(every, "all", True).unionByName(gate(pairs, "pairs", False))


PACKAGE_SQL = ENTRY_SQL + """, f AS (SELECT page_id, concat(path, CASE page_id % 6 WHEN 0 THEN '/a.docx' WHEN 1 THEN '/State/x.py' WHEN 2 THEN '/chat_exports/c.db' WHEN 3 THEN '/.git/y.pdf' WHEN 4 THEN '/events.jsonl' ELSE '/n.py' END) AS path, page_id % 6 AS k FROM e),
h AS (SELECT 'real_project_artifacts' AS category, count(*) FILTER (k = 0) AS n FROM f UNION ALL SELECT 'machine_state', count(*) FILTER (k IN (1, 2, 4)) FROM f UNION ALL SELECT 'private_communication_records', count(*) FILTER (k = 2) FROM f UNION ALL SELECT 'personal_paths', 2 * count(*) FILTER (page_id % 9 = 0) FROM f UNION ALL SELECT 'credentials', count(*) FILTER (page_id % 8 = 0) FROM f
UNION ALL SELECT 'real_project_artifacts', count(*) FILTER (page_id % 50 = 0) FROM f)
"""


@query(PACKAGE_SQL + "SELECT category, CAST(sum(n) AS BIGINT) AS n, false AS pass FROM h GROUP BY 1")
def package_audit(spark, sf):
    """File names, and made-up texts, in all five categories."""
    k, n = F.col("page_id") % 6, F.col("page_id")
    end = F.when(k == 0, "/a.docx").when(k == 1, "/State/x.py").when(k == 2, "/chat_exports/c.db").when(k == 3, "/.git/y.pdf").when(k == 4, "/events.jsonl").otherwise("/n.py")
    f = entries(spark, sf).select("page_id", F.concat("path", end).alias("path"), F.concat(F.when(n % 9 == 0, "see C:\\a\\b and D:/c\n").otherwise(""), F.when(n % 8 == 0, "to a.b@c.org or d@e.net").otherwise("")).alias("text"))
    found = text.findings(text.lines(f.select(F.col("page_id").cast("string").alias("path"), "text"), "path", "text"), "path", text.PRIVACY_PATTERNS)
    return audit.package_audit(f, found, f.where("page_id % 50 = 0").select("path"))
