"""Event histories. events stand for the log: user_id % 50 is the project, event types map to the log's types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions import importance
from ledgerlake.operators import changes, history, matching

from .registry import query, table

KINDS = {"click": "FILE_CREATED", "view": "FILE_CHANGED", "purchase": "LARGE_ASSET_CREATED", "signup": "AUTHORITY_CHANGED", "error": "FILE_MISSING"}
AS_OF = "2024-01-31 00:00:00"

EVENT_SQL = """
WITH r AS (SELECT event_id, ts AS occurred_at, user_id % 50 AS project_id, CASE event_type WHEN 'click' THEN 'FILE_CREATED' WHEN 'view' THEN 'FILE_CHANGED' WHEN 'purchase' THEN 'LARGE_ASSET_CREATED'
  WHEN 'signup' THEN 'AUTHORITY_CHANGED' ELSE 'FILE_MISSING' END AS event_type, CAST(floor(value * 1000) AS BIGINT) AS size_delta, CAST(floor(value * 30000000) AS BIGINT) AS size,
  event_id % 11 = 0 AS volatile, event_id % 7 AS dependents, CASE event_id % 5 WHEN 0 THEN 'CANONICAL' WHEN 1 THEN 'ACTIVE' ELSE 'UNKNOWN' END AS authority,
  CASE event_id % 4 WHEN 0 THEN 'manuscript' WHEN 1 THEN 'final' ELSE 'figure' END AS role, event_id % 13 = 0 AS rebuildable FROM events),
s AS (SELECT *, CASE WHEN volatile THEN 0.0 ELSE round(greatest(0.0, least(100.0, CAST(
    CASE event_type WHEN 'FILE_CREATED' THEN 14 WHEN 'FILE_CHANGED' THEN 40 WHEN 'LARGE_ASSET_CREATED' THEN 32 WHEN 'AUTHORITY_CHANGED' THEN 48 ELSE 28 END
    + CASE authority WHEN 'CANONICAL' THEN 30 WHEN 'ACTIVE' THEN 20 ELSE 0 END + CASE role WHEN 'manuscript' THEN 18 WHEN 'final' THEN 12 ELSE 0 END
    + CASE WHEN size >= 4294967296 THEN 18 WHEN size >= 1073741824 THEN 12 WHEN size >= 268435456 THEN 7 ELSE 0 END
    + CASE WHEN dependents > 0 THEN least(12.0, 2 + 2 * log2(dependents + 1.0)) ELSE 0.0 END - CASE WHEN rebuildable THEN 12 ELSE 0 END AS DOUBLE))), 2) END AS importance_score FROM r),
e AS (SELECT *, 1 AS aggregate_count, CASE WHEN volatile THEN 'VOLATILE' WHEN importance_score >= 85 THEN 'VERY_HIGH' WHEN importance_score >= 65 THEN 'HIGH' WHEN importance_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS semantic_importance FROM s),
l AS (SELECT *, semantic_importance IN ('VERY_HIGH', 'HIGH') OR event_type = 'AUTHORITY_CHANGED' AS permanent FROM e)
"""


def log(spark: SparkSession, sf: str) -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    k = F.col("event_id")
    r = table(spark, sf, "events").select(
        "event_id", F.col("ts").alias("occurred_at"), (F.col("user_id") % 50).alias("project_id"), F.element_at(m, F.col("event_type")).alias("event_type"),
        F.floor(F.col("value") * 1000).alias("size_delta"), F.floor(F.col("value") * 30_000_000).alias("size"), (k % 11 == 0).alias("volatile"), (k % 7).alias("dependents"),
        F.when(k % 5 == 0, "CANONICAL").when(k % 5 == 1, "ACTIVE").otherwise("UNKNOWN").alias("authority"), F.when(k % 4 == 0, "manuscript").when(k % 4 == 1, "final").otherwise("figure").alias("role"), (k % 13 == 0).alias("rebuildable"),
    )
    c = F.col
    r = r.withColumn("importance_score", importance.score(c("event_type"), c("authority"), c("role"), c("size"), c("dependents"), c("rebuildable"), F.lit(False), c("volatile")))
    r = r.withColumn("semantic_importance", importance.importance(c("importance_score"), c("volatile"))).withColumn("aggregate_count", F.lit(1))
    return r.withColumn("permanent", importance.permanent(c("semantic_importance"), c("event_type")))


@query(EVENT_SQL + "SELECT event_id, occurred_at, event_type, project_id, importance_score, semantic_importance FROM l WHERE occurred_at >= TIMESTAMP '2024-01-10 00:00:00' AND occurred_at <= TIMESTAMP '2024-01-20 00:00:00' ORDER BY occurred_at DESC, importance_score DESC, event_id DESC LIMIT 500")
def timeline_top_changes(spark, sf):
    rows = history.in_range(log(spark, sf), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return history.timeline(rows).select("event_id", "occurred_at", "event_type", "project_id", "importance_score", "semantic_importance")


@query(EVENT_SQL + "SELECT event_id, occurred_at, importance_score FROM l WHERE project_id = 7 AND event_type = 'FILE_CHANGED' AND semantic_importance = 'MEDIUM' AND occurred_at <= TIMESTAMP '2024-01-31 00:00:00' ORDER BY occurred_at DESC, importance_score DESC, event_id DESC LIMIT 5000")
def timeline_filtered(spark, sf):
    rows = history.in_range(log(spark, sf), None, F.lit(AS_OF).cast("timestamp_ntz"), project_id=7, event_type="FILE_CHANGED", semantic_importance="MEDIUM")
    return history.timeline(rows, 999_999).select("event_id", "occurred_at", "importance_score")


@query(EVENT_SQL + "SELECT semantic_importance, count(*) AS events, CAST(sum(aggregate_count) AS BIGINT) AS weight FROM l GROUP BY 1")
def importance_histogram(spark, sf):
    return history.run_counters(log(spark, sf))


def rollup_sql(where: str) -> str:
    return EVENT_SQL + f""", x AS (SELECT * FROM l WHERE {where})
SELECT project_id, CAST(sum(aggregate_count) AS BIGINT) AS event_count, CAST(sum(CASE WHEN semantic_importance NOT IN ('LOW', 'VOLATILE') THEN 1 ELSE 0 END) AS BIGINT) AS meaningful_count,
 CAST(sum(CASE WHEN event_type IN ('FILE_CREATED', 'FILE_CHANGED', 'FILE_MISSING') THEN size_delta ELSE 0 END) AS BIGINT) AS storage_delta, arg_min(event_id, (-importance_score, event_id)) AS top_event_id, max(importance_score) AS top_score,
 count(*) FILTER (event_type = 'AUTHORITY_CHANGED') AS authority_changes FROM x GROUP BY 1"""


def rollup(events: DataFrame, with_volatile: bool) -> DataFrame:
    out = history.project_rollup(events, with_volatile)
    return out.withColumn("authority_changes", F.coalesce(F.element_at("type_counts", F.lit("AUTHORITY_CHANGED")), F.lit(0)).cast("long")).drop("type_counts")


@query(rollup_sql("semantic_importance <> 'VOLATILE'"))
def project_rollup_semantic(spark, sf):
    return rollup(log(spark, sf), False)


@query(rollup_sql("true"))
def context_summary_by_project(spark, sf):
    return rollup(log(spark, sf), True)


@query(EVENT_SQL + """, m AS (SELECT project_id, max(occurred_at) FILTER (semantic_importance IN ('MEDIUM', 'HIGH', 'VERY_HIGH') ) AS last_meaningful,
 count(*) FILTER (occurred_at >= TIMESTAMP '2024-01-29 12:00:00' AND semantic_importance = 'VERY_HIGH') AS run_events, coalesce(max(importance_score) FILTER (occurred_at >= TIMESTAMP '2024-01-29 12:00:00' AND semantic_importance = 'VERY_HIGH'), 0.0) AS run_score FROM l GROUP BY 1),
a AS (SELECT *, CASE WHEN project_id % 10 = 1 THEN 'PAUSED' END AS asserted, CASE WHEN project_id % 10 = 2 THEN 'FROZEN' WHEN project_id % 10 = 3 THEN 'COMPLETED' END AS lifecycle,
 CAST(floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00' + to_days(CAST(project_id % 4 * 12 AS INTEGER))) - epoch_us(last_meaningful)) / 86400000000) AS BIGINT) AS age_days FROM m)
SELECT project_id, age_days, CASE WHEN asserted IS NOT NULL THEN asserted WHEN lifecycle IS NOT NULL THEN lifecycle WHEN run_events > 0 THEN 'ACTIVE' WHEN age_days >= 30 THEN 'DORMANT' WHEN age_days >= 7 THEN 'LOW_ACTIVITY' WHEN age_days IS NOT NULL THEN 'ACTIVE' ELSE 'UNKNOWN' END AS status,
 CAST(CASE WHEN asserted IS NOT NULL THEN 100 WHEN lifecycle IS NOT NULL THEN 95 WHEN run_events > 0 THEN least(100.0, 45 + run_score / 2) WHEN age_days IS NOT NULL THEN greatest(10.0, 70.0 - 2 * age_days) ELSE 20 END AS DOUBLE) AS activity_score FROM a""")
def activity_status(spark, sf):
    e = log(spark, sf)
    recent = (F.col("occurred_at") >= F.lit("2024-01-29 12:00:00").cast("timestamp_ntz")) & (F.col("semantic_importance") == "VERY_HIGH")
    told = F.col("semantic_importance").isin("MEDIUM", "HIGH", "VERY_HIGH")
    p = e.groupBy("project_id").agg(F.max(F.when(told, F.col("occurred_at").cast("timestamp"))).alias("last_meaningful"), F.count_if(recent).alias("run_events"), F.coalesce(F.max(F.when(recent, F.col("importance_score"))), F.lit(0.0)).alias("run_score"))
    k = F.col("project_id") % 10
    p = p.withColumns({"asserted": F.when(k == 1, "PAUSED"), "lifecycle": F.when(k == 2, "FROZEN").when(k == 3, "COMPLETED")})
    # Projects are looked at on different days, so that all states come up.
    at = F.lit(AS_OF).cast("timestamp") + F.make_dt_interval((F.col("project_id") % 4 * 12).cast("int"))
    return history.activity(p, at).select("project_id", "age_days", "status", "activity_score")


SNAPSHOT_SQL = """
WITH s AS (SELECT CAST(o_orderdate AS DATE) AS day, o_custkey % 20 AS project_id, count(*) AS file_count, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS total_size FROM orders GROUP BY ALL)
"""


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    s = o.groupBy(F.to_date("o_orderdate").alias("created_at"), (F.col("o_custkey") % 20).alias("project_id")).agg(F.count("*").alias("file_count"), F.sum(F.round("o_totalprice").cast("long")).alias("total_size"))
    return s.withColumn("snapshot_id", F.date_format("created_at", "yyyyMMdd"))


@query(SNAPSHOT_SQL + "SELECT day, project_id, file_count, total_size, total_size - lag(total_size) OVER (PARTITION BY project_id ORDER BY day) AS change FROM s")
def snapshot_daily(spark, sf):
    out = history.with_previous(snapshots(spark, sf), "total_size")
    return out.select(F.col("created_at").alias("day"), "project_id", "file_count", "total_size", "change")


@query(SNAPSHOT_SQL + """, d AS (SELECT coalesce(max(day) FILTER (day <= DATE '1996-06-15'), min(day)) AS d0, max(day) AS d1 FROM s)
SELECT a.project_id, a.total_size AS start_size, b.total_size AS end_size, b.total_size - a.total_size AS growth FROM s a JOIN s b ON a.project_id = b.project_id, d WHERE a.day = d.d0 AND b.day = d.d1""")
def storage_growth_asof(spark, sf):
    s = snapshots(spark, sf)
    start = history.snapshot_as_of(s, F.lit("1996-06-15").cast("date"))
    end = s.agg(F.max("snapshot_id").alias("snapshot_id"))
    return history.storage_growth(s.join(F.broadcast(start), "snapshot_id", "left_semi"), s.join(F.broadcast(end), "snapshot_id", "left_semi"))


@query("""WITH f AS (SELECT source AS p, count(*) AS file_count, sum(n_chars) AS s, max(doc_id) AS last_modified FROM documents GROUP BY 1), a AS (SELECT concat('src', page_id % 25) AS p, sum(length(html)) AS s FROM pages GROUP BY 1)
SELECT coalesce(f.p, a.p) AS project_id, coalesce(file_count, 0) AS file_count, CAST(coalesce(f.s, 0) + coalesce(a.s, 0) AS BIGINT) AS total_size, last_modified FROM f FULL JOIN a ON f.p = a.p""")
def snapshot_projects(spark, sf):
    f = table(spark, sf, "documents").select(F.col("source").alias("project_id"), F.col("n_chars").alias("size"), F.col("doc_id").alias("modified"))
    a = table(spark, sf, "pages").select(F.concat(F.lit("src"), (F.col("page_id") % 25).cast("string")).alias("project_id"), F.length("html").alias("total_size"))
    return history.snapshot(f, a)


@query(EVENT_SQL + "SELECT event_id, occurred_at FROM l WHERE semantic_importance = 'VOLATILE' AND NOT permanent AND occurred_at < TIMESTAMP '2024-02-15 00:00:00' - INTERVAL 30 DAY")
def retention_eligible(spark, sf):
    return history.retention(log(spark, sf), F.lit("2024-02-15 00:00:00").cast("timestamp_ntz")).select("event_id", "occurred_at")


@query("""WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), r AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase')
SELECT event_id, user_id, ts FROM a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = a.user_id AND r.ts > a.ts)""")
def alerts_open(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return changes.open_alerts(e.where("event_type = 'error'").drop("event_type"), e.where("event_type = 'purchase'"), "user_id", "ts").select("event_id", "user_id", "ts")


@query("""SELECT event_id, ts, value, v AS last_price FROM (SELECT e.event_id, e.ts, e.value, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v, event_type FROM events e) WHERE event_type = 'view'""")
def asof_last_fact(spark, sf):
    e = table(spark, sf, "events")
    at = F.struct("ts", "event_id")
    views = e.where("event_type = 'view'").select("user_id", "event_id", "ts", F.col("value").alias("view_value"), at.alias("at"))
    facts = e.where("event_type = 'purchase'").select("user_id", at.alias("at"), "value")
    return matching.latest_at(views, facts, "user_id", "at").select("event_id", "ts", F.col("view_value").alias("value"), F.col("value").alias("last_price"))


@query("""SELECT project_id, event_id, importance_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY importance_score DESC, event_id) AS rank FROM (""" + EVENT_SQL + """SELECT * FROM l)) WHERE rank <= 12""")
def top_events_per_project(spark, sf):
    return history.top_per_group(log(spark, sf), "project_id", [F.desc("importance_score"), F.col("event_id")], 12).select("project_id", "event_id", "importance_score", "rank")


@query("""SELECT doc_id, n_chars, CAST(spent AS BIGINT) AS spent FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY n_chars DESC, doc_id) AS spent FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100)) WHERE spent <= 200000""")
def top_k_budgeted(spark, sf):
    return history.within_budget(table(spark, sf, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], "n_chars", 200_000, 100)
