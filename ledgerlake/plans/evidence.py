"""Gates, grids and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.operators import gates, graphs, grids

from .registry import query, table

CHECK_SQL = """
WITH s AS (SELECT o_orderpriority AS check_id, round(sum(o_totalprice), 2) AS a FROM orders GROUP BY 1),
t AS (SELECT o_orderpriority AS check_id, round(sum(l_extendedprice * (1 - l_discount)), 2) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
c AS (SELECT check_id, CASE WHEN check_id LIKE '1%' THEN 0.0 ELSE a END AS source_value, b AS target_value, CASE WHEN check_id LIKE '5%' THEN 'absolute_error' ELSE 'relative_error' END AS metric, 0.5 AS low FROM s JOIN t USING (check_id)),
m AS (SELECT *, CASE WHEN metric = 'absolute_error' THEN abs(target_value - source_value) WHEN source_value = 0 THEN CASE WHEN target_value = 0 THEN 0.0 END ELSE abs(target_value - source_value) / abs(source_value) END AS measured FROM c),
g AS (SELECT check_id, measured, CASE WHEN measured IS NULL THEN 'PARTIAL' WHEN measured <= low THEN 'PASS' ELSE 'FAIL' END AS status,
 CASE WHEN measured IS NULL THEN ['ZERO_REFERENCE_VALUE'] WHEN measured <= low THEN CAST([] AS VARCHAR[]) ELSE ['CONSERVATION_CRITERION_FAILED'] END AS reason_codes FROM m)
"""


def checks(spark: SparkSession, sf: str) -> DataFrame:
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    a = o.groupBy(F.col("o_orderpriority").alias("check_id")).agg(F.round(F.sum("o_totalprice"), 2).alias("a"))
    b = li.join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy(F.col("o_orderpriority").alias("check_id")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("target_value"))
    c = a.join(b, "check_id").withColumn("source_value", F.when(F.col("check_id").like("1%"), 0.0).otherwise(F.col("a")))
    c = c.withColumns({"metric": F.when(F.col("check_id").like("5%"), "absolute_error").otherwise("relative_error"), "operator": F.lit("lte"), "low": F.lit(0.5), "high": F.lit(None).cast("double")})
    return gates.conservation(c)


@query(CHECK_SQL + "SELECT check_id, round(measured, 6) AS measured_value, status, reason_codes FROM g")
def conservation_gate(spark, sf):
    return checks(spark, sf).select("check_id", F.round("measured_value", 6).alias("measured_value"), "status", "reason_codes")


# Gates per order: the status of a line stands for a check's, its number for the order of checks.
GATE_SQL = """
WITH g AS (SELECT l_orderkey AS report, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ord, l_returnflag <> 'N' OR l_linenumber < 3 AS required, CASE WHEN l_quantity > 45 THEN 'FAIL' WHEN l_quantity > 35 THEN 'PARTIAL' WHEN l_quantity > 25 THEN 'SKIPPED' ELSE 'PASS' END AS status,
 CASE WHEN l_quantity > 25 THEN [concat('LINE_', l_linestatus), concat('TAX_', CAST(CAST(round(l_tax * 100) AS INT) AS VARCHAR))] ELSE CAST([] AS VARCHAR[]) END AS codes FROM lineitem),
f AS (SELECT report, ord, required, status, unnest(codes) AS code, unnest(range(len(codes))) AS k FROM g)
"""


def order_gates(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    q = F.col("l_quantity")
    status = F.when(q > 45, "FAIL").when(q > 35, "PARTIAL").when(q > 25, "SKIPPED").otherwise("PASS")
    codes = F.when(q > 25, F.array(F.concat(F.lit("LINE_"), "l_linestatus"), F.concat(F.lit("TAX_"), F.round(F.col("l_tax") * 100).cast("int").cast("string")))).otherwise(F.array().cast("array<string>"))
    return li.select(F.col("l_orderkey").alias("report"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).alias("ord"), ((F.col("l_returnflag") != "N") | (F.col("l_linenumber") < 3)).alias("required"), status.alias("status"), codes.alias("reason_codes"))


@query(GATE_SQL + """, n AS (SELECT report, count(*) AS n, count(*) FILTER (status = 'FAIL') AS f, count(*) FILTER (status = 'PARTIAL') AS p, count(*) FILTER (status = 'SKIPPED') AS s FROM g WHERE required GROUP BY 1),
w AS (SELECT n.report, CASE WHEN f > 0 THEN 'FAIL' WHEN p > 0 THEN 'PARTIAL' WHEN s = n AND s > 0 THEN 'SKIPPED' WHEN s > 0 THEN 'PARTIAL' ELSE 'PASS' END AS status,
 CASE WHEN f > 0 THEN 'REQUIRED_GATE_FAILED' WHEN p > 0 THEN 'REQUIRED_GATE_PARTIAL' WHEN s = n AND s > 0 THEN 'ALL_REQUIRED_GATES_SKIPPED' WHEN s > 0 THEN 'REQUIRED_GATE_SKIPPED' END AS lead,
 CASE WHEN f > 0 THEN ['FAIL'] WHEN p > 0 THEN ['PARTIAL', 'SKIPPED'] ELSE ['SKIPPED'] END AS deciding FROM n),
c AS (SELECT w.report, code, min(CASE f.status WHEN 'SKIPPED' THEN 1 ELSE 0 END * 1000000 + ord * 10 + k) AS first_at FROM w JOIN f ON f.report = w.report AND f.required AND list_contains(deciding, f.status) GROUP BY ALL),
l AS (SELECT report, list(code ORDER BY first_at) AS codes FROM c GROUP BY 1)
SELECT w.report, w.status, CASE WHEN lead IS NULL THEN CAST([] AS VARCHAR[]) ELSE list_concat([lead], coalesce(codes, [])) END AS reason_codes FROM w LEFT JOIN l ON w.report = l.report""")
def gate_overall(spark, sf):
    return gates.required_gates(order_gates(spark, sf), ["report"])


@query(GATE_SQL + """, n AS (SELECT report, count(*) FILTER (status = 'FAIL') AS f, count(*) FILTER (status IN ('PARTIAL', 'SKIPPED')) AS p FROM g GROUP BY 1),
w AS (SELECT report, CASE WHEN f > 0 THEN 'FAIL' WHEN p > 0 THEN 'PARTIAL' ELSE 'PASS' END AS status, CASE WHEN f > 0 THEN ['FAIL'] ELSE ['PARTIAL', 'SKIPPED'] END AS deciding FROM n),
c AS (SELECT w.report, code, min(ord * 10 + k) AS first_at FROM w JOIN f ON f.report = w.report AND list_contains(deciding, f.status) GROUP BY ALL),
l AS (SELECT report, list(code ORDER BY first_at) AS codes FROM c GROUP BY 1)
SELECT w.report, w.status, coalesce(codes, CAST([] AS VARCHAR[])) AS reason_codes FROM w LEFT JOIN l ON w.report = l.report""")
def readiness_merge(spark, sf):
    return gates.merge_readiness(order_gates(spark, sf), ["report"])


@query("""WITH s AS (SELECT c_mktsegment AS field, count(*) FILTER (c_nationkey < 12) AS a, count(*) FILTER (c_nationkey >= 12) AS b FROM customer GROUP BY 1),
c AS (SELECT field, CASE WHEN a > 0 AND field <> 'MACHINERY' THEN CAST(a AS DOUBLE) END AS a, CASE WHEN b > 0 THEN CAST(b AS DOUBLE) END AS b FROM s UNION ALL SELECT 'NOWHERE', NULL, NULL)
SELECT field, a IS NULL OR b IS NULL AS missing, coalesce(CASE WHEN field = 'BUILDING' THEN a = b ELSE abs(a - b) / greatest(abs(a), abs(b)) <= 0.15 OR abs(a - b) <= 5 END, false) AS equal,
 CASE WHEN a IS NULL OR b IS NULL THEN ['FAIRNESS_CONDITION_MISSING', 'FAIRNESS_CONDITION_MISMATCH'] WHEN coalesce(CASE WHEN field = 'BUILDING' THEN a = b ELSE abs(a - b) / greatest(abs(a), abs(b)) <= 0.15 OR abs(a - b) <= 5 END, false) THEN CAST([] AS VARCHAR[]) ELSE ['FAIRNESS_CONDITION_MISMATCH'] END AS reason_codes FROM c""")
def fairness_gate(spark, sf):
    c = table(spark, sf, "customer")
    case = lambda rows: rows.groupBy(F.col("c_mktsegment").alias("field")).agg(F.count("*").cast("string").alias("value"), F.count("*").cast("double").alias("number"))
    fields = c.select(F.col("c_mktsegment").alias("field")).union(spark.createDataFrame([("NOWHERE",)], "field string")).distinct()
    criteria = fields.select("field", F.when(F.col("field") == "BUILDING", "exact").otherwise("absolute-or-relative").alias("mode"), F.lit(5.0).alias("absolute"), F.lit(0.15).alias("relative"), F.lit("max-absolute").alias("reference"))
    out = gates.fairness(case(c.where("c_nationkey < 12 and c_mktsegment <> 'MACHINERY'")), case(c.where("c_nationkey >= 12")), criteria)
    return out.select("field", "missing", "equal", "reason_codes")


@query("""WITH r AS (SELECT o_orderkey AS regression_id, CASE o_orderkey % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'PARTIAL' ELSE 'PASS' END AS s, o_orderkey % 9 <> 0 AS authorized, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE CASE WHEN o_orderkey % 7 = 3 THEN 2 ELSE 0 END END AS x FROM orders)
SELECT regression_id, CASE WHEN NOT authorized THEN 'FAIL' WHEN s = 'FAIL' OR coalesce(x <> 0, false) THEN 'FAIL' WHEN s = 'PARTIAL' OR x IS NULL THEN 'PARTIAL' ELSE 'PASS' END AS status,
 CASE WHEN NOT authorized THEN ['UNAUTHORIZED_REGRESSION_RECORD'] WHEN s = 'FAIL' AND coalesce(x <> 0, false) THEN ['CODE_A', 'UPSTREAM_RUN_FAILED'] WHEN s = 'FAIL' THEN ['CODE_A'] WHEN coalesce(x <> 0, false) THEN ['UPSTREAM_RUN_FAILED'] WHEN s = 'PARTIAL' THEN ['CODE_A'] WHEN x IS NULL THEN ['REGRESSION_RECORD_INCOMPLETE'] ELSE CAST([] AS VARCHAR[]) END AS reason_codes FROM r""")
def regression_eval(spark, sf):
    k = F.col("o_orderkey")
    s = F.when(k % 4 == 1, "FAIL").when(k % 4 == 2, "PARTIAL").otherwise("PASS")
    r = table(spark, sf, "orders").select(k.alias("regression_id"), s.alias("status"), F.when(s != "PASS", F.array(F.lit("CODE_A"), F.lit("CODE_A"))).otherwise(F.array().cast("array<string>")).alias("reason_codes"), (k % 9 != 0).alias("authorized"), F.when(k % 6 == 5, None).otherwise(F.when(k % 7 == 3, 2).otherwise(0)).alias("exit_code"), F.col("o_orderdate").alias("executed_at"), F.lit("ref").alias("actual_ref"))
    return gates.regressions(r)


@query("""WITH a AS (SELECT doc_id, sha256(text) AS sha256, doc_id % 10 = 0 AS external FROM documents), p AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN sha256(concat(text, '!')) ELSE sha256(text) END AS f FROM documents WHERE doc_id % 5 <> 1)
SELECT a.doc_id AS artifact_id, CASE WHEN external THEN 'PARTIAL' WHEN p.f IS NULL OR p.f <> sha256 THEN 'FAIL' ELSE 'PASS' END AS status,
 CASE WHEN external THEN ['EXTERNAL_ARTIFACT_NOT_RESOLVED'] WHEN p.f IS NULL THEN ['MISSING_REQUIRED_FILE'] WHEN p.f <> sha256 THEN ['HASH_MISMATCH'] ELSE CAST([] AS VARCHAR[]) END AS reason_codes FROM a LEFT JOIN p USING (doc_id)""")
def package_verify(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    want = d.select(k.alias("artifact_id"), k.cast("string").alias("path"), F.sha2("text", 256).alias("sha256"), (k % 10 == 0).alias("external"))
    have = d.where("doc_id % 5 <> 1").select(k.cast("string").alias("path"), F.when(k % 7 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("sha256"))
    return gates.verify_package(want, have).drop("path")


# lineitem's quantities and discounts make a grid of 50 by 11 cells; a cell's field value is its row count.
SOURCE = grids.Grid((50, 11), (1.0, 1.0), (0.5, -0.5))
TARGET = grids.Grid((40, 8), (1.25, 1.375), (0.5, -0.5))
FIELD_SQL = """
WITH f AS (SELECT CAST(l_quantity AS INT) - 1 AS i, CAST(round(l_discount * 100) AS INT) AS j, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY ALL),
tx AS (SELECT range AS ti, 0.5 + range * 1.25 AS a FROM range(40)), ty AS (SELECT range AS tj, -0.5 + range * 1.375 AS a FROM range(8)),
wx AS (SELECT ti, range AS i, least(a + 1.25, 1.5 + range) - greatest(a, 0.5 + range) AS w FROM tx, range(50) WHERE least(a + 1.25, 1.5 + range) - greatest(a, 0.5 + range) > 1e-9),
wy AS (SELECT tj, range AS j, least(a + 1.375, 0.5 + range) - greatest(a, range - 0.5) AS w FROM ty, range(11) WHERE least(a + 1.375, 0.5 + range) - greatest(a, range - 0.5) > 1e-9),
r AS (SELECT CAST(ti AS INT) AS i, CAST(tj AS INT) AS j, sum(value * wx.w * wy.w) / (1.25 * 1.375) AS value, sum(wx.w * wy.w) / (1.25 * 1.375) AS coverage FROM f JOIN wx USING (i) JOIN wy USING (j) GROUP BY ALL)
"""


def field(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy((F.col("l_quantity").cast("int") - 1).alias("i"), F.round(F.col("l_discount") * 100).cast("int").alias("j")).agg(F.count("*").cast("double").alias("value"))


@query(FIELD_SQL + "SELECT i, j, round(value, 6) AS value, round(coverage, 6) AS coverage FROM r")
def grid_regrid(spark, sf):
    out = grids.regrid(field(spark, sf), SOURCE, TARGET)
    return out.select("i", "j", F.round("value", 6).alias("value"), F.round("coverage", 6).alias("coverage"))


@query(FIELD_SQL + "SELECT round((SELECT sum(value) FROM f), 6) AS source_integral, round((SELECT sum(value) * 1.25 * 1.375 FROM r), 6) AS target_integral, 'PASS' AS status, CAST([] AS VARCHAR[]) AS reason_codes")
def grid_integral(spark, sf):
    f = field(spark, sf)
    out = grids.integral_check(f, SOURCE, grids.regrid(f, SOURCE, TARGET), TARGET, 1e-9)
    return out.select(F.round("source_integral", 6).alias("source_integral"), F.round("target_integral", 6).alias("target_integral"), "status", "reason_codes")


@query("""WITH r AS (SELECT o_orderkey AS row, o_orderkey % 50 + 1 AS x, o_orderkey % 11 AS y, o_orderkey % 101 AS k FROM orders),
t AS (SELECT row, CASE WHEN k = 1 THEN NULL ELSE x + CASE WHEN k = 4 THEN 0.25 ELSE 0 END END AS x, y, CASE WHEN k = 2 THEN NULL WHEN k = 3 THEN NULL ELSE x * y END AS v, k FROM r),
d AS (SELECT x, y FROM t WHERE k NOT IN (1, 2, 3) GROUP BY ALL HAVING count(*) > 1)
SELECT row, CASE WHEN k = 1 THEN ['MISSING_VALUE'] WHEN k = 2 THEN ['NONNUMERIC_VALUE'] WHEN k = 3 THEN ['NONFINITE_VALUE'] ELSE CAST([] AS VARCHAR[]) END || CASE WHEN d.x IS NOT NULL THEN ['DUPLICATE_COORDINATE'] ELSE CAST([] AS VARCHAR[]) END || CASE WHEN k = 4 THEN ['GRID_COORDINATE_MISMATCH'] ELSE CAST([] AS VARCHAR[]) END AS reason_codes
FROM t LEFT JOIN d ON t.x = d.x AND t.y = d.y""")
def grid_validate(spark, sf):
    o = F.col("o_orderkey")
    x, y, k = o % 50 + 1, o % 11, o % 101
    raw = table(spark, sf, "orders").select(o.alias("row"), F.when(k == 1, " ").otherwise((x + F.when(k == 4, 0.25).otherwise(0)).cast("string")).alias("x"), y.cast("string").alias("y"), F.when(k == 2, "abc").when(k == 3, "nan").otherwise((x * y).cast("string")).alias("value"))
    return grids.validate_table(raw, SOURCE).select("row", "reason_codes")


@query("SELECT DISTINCT CAST(l_quantity AS INT) - 1 AS i, CAST(round(l_discount * 100) AS INT) AS j, round(2.0 * round(l_discount * 100) + 3, 6) AS x, round(-0.5 * l_quantity + 1, 6) AS y FROM lineitem")
def grid_normalize(spark, sf):
    f = field(spark, sf).select("i", "j", (F.col("i") + 1.0).alias("x"), F.col("j").cast("double").alias("y"))
    return grids.normalize(f, (1, 0), (2.0, -0.5), (3.0, 1.0)).select("i", "j", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


EDGE_SQL = """
WITH RECURSIVE e AS (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS src, CAST((s_nationkey * 5 + s_suppkey % 2) % 25 AS BIGINT) AS dst FROM supplier), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)
"""


def nation_edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("src"), ((F.col("s_nationkey") * 5 + F.col("s_suppkey") % 2) % 25).cast("long").alias("dst")).distinct()


@query(EDGE_SQL + ", r AS (SELECT CAST(n_nationkey AS BIGINT) AS start, CAST(n_nationkey AS BIGINT) AS node FROM nation UNION SELECT r.start, e.dst FROM r JOIN e ON r.node = e.src) SELECT start, node FROM r")
def graph_reachable(spark, sf):
    return graphs.reachable(nation_edges(spark, sf), table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("start")))


@query(EDGE_SQL + ", r AS (SELECT CAST(n_nationkey AS BIGINT) AS start, CAST(n_nationkey AS BIGINT) AS node FROM nation UNION SELECT r.start, b.dst FROM r JOIN b ON r.node = b.src) SELECT node, min(start) AS component FROM r GROUP BY 1")
def graph_components(spark, sf):
    return graphs.weak_components(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("node")), nation_edges(spark, sf))


@query(EDGE_SQL + """, p AS (SELECT CAST(a.n_nationkey AS BIGINT) AS src, CAST((a.n_nationkey * 3 + 1) % 25 AS BIGINT) AS dst FROM nation a), r AS (SELECT src AS start, src AS node FROM p UNION SELECT r.start, e.dst FROM r JOIN e ON r.node = e.src)
SELECT src, dst, EXISTS (SELECT 1 FROM r WHERE r.start = p.src AND r.node = p.dst) AS connected FROM p""")
def required_pairs(spark, sf):
    n = F.col("n_nationkey").cast("long")
    return graphs.pairs_connected(nation_edges(spark, sf), table(spark, sf, "nation").select(n.alias("src"), ((n * 3 + 1) % 25).alias("dst")))


@query(EDGE_SQL + """, r AS (SELECT CAST(n_nationkey AS BIGINT) AS start, CAST(n_nationkey AS BIGINT) AS node FROM nation UNION SELECT r.start, e.dst FROM r JOIN e ON r.node = e.src)
SELECT (SELECT count(*) FROM nation) AS nodes, (SELECT count(*) FROM r) = (SELECT count(*) * count(*) FROM nation) AS connected""")
def strongly_connected(spark, sf):
    return graphs.all_connected(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("node")), nation_edges(spark, sf), directed=True)
