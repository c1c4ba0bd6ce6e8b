"""Histories over an append-only event log: time ranges, rollups, snapshots, activity, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.functions.importance import STORAGE_EVENT_TYPES

MOST_ROWS = 5000


def in_range(events: DataFrame, start=None, end=None, **equal) -> DataFrame:
    """Events between two times, both included, and with the given values; every part reaches the scan as a pushed filter."""
    if start is not None:
        events = events.where(F.col("occurred_at") >= start)
    if end is not None:
        events = events.where(F.col("occurred_at") <= end)
    for column, value in equal.items():
        if value is not None:
            events = events.where(F.col(column) == value)
    return events


def timeline(events: DataFrame, limit: int = 500) -> DataFrame:
    """Newest first, then by score, then id; between 1 and MOST_ROWS rows."""
    return events.orderBy(F.desc("occurred_at"), F.desc("importance_score"), F.desc("event_id")).limit(max(1, min(limit, MOST_ROWS)))


def newest(events: DataFrame, limit: int) -> DataFrame:
    """The newest events with their rank; between 1 and MOST_ROWS of them."""
    order = [F.desc("occurred_at"), F.desc("event_id")]
    return numbered(events.orderBy(*order).limit(max(1, min(limit, MOST_ROWS))), order)


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Ranks of rows that a limit has already bounded."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def days_before(at: Column, days: int) -> Column:
    return at - F.make_dt_interval(F.lit(max(0, days)))


def public_events(events: DataFrame) -> DataFrame:
    """Events under their public names; columns that the log lacks are null, numbers default to 0, and a count to 1."""
    has = lambda c, t: (F.col(c) if c in events.columns else F.lit(None)).cast(t)
    text = {"event_id": "event_id", "event_type": "event_type", "project_id": "project_id", "workstream_id": "workstream_id", "file_id": "file_id", "path_before": "path_before", "path_after": "path_after", "importance": "semantic_importance", "resolution_status": "resolution_status"}
    kinds = dict(events.dtypes)
    return events.select(
        *[has(c, kinds.get(c, "string")).alias(n) for n, c in text.items()], F.col("occurred_at").alias("timestamp"), F.coalesce(has("size_delta", "long"), F.lit(0)).alias("size_delta"),
        *[F.coalesce(has(c, "double"), F.lit(0.0)).alias(c) for c in ("importance_score", "confidence")], F.coalesce(has("aggregate_count", "long"), F.lit(1)).alias("aggregate_count"),
    )


def storage_delta() -> Column:
    return F.sum(F.when(F.col("event_type").isin(STORAGE_EVENT_TYPES), F.col("size_delta")).otherwise(0)).cast("long")


def meaningful() -> Column:
    return ~F.col("semantic_importance").isin("LOW", "VOLATILE")


def project_rollup(events: DataFrame, with_volatile: bool) -> DataFrame:
    """Per project: event count, meaningful count, storage change, top event, histogram of types.

    with_volatile: whether volatile events count (context summaries) or groups of nothing else drop out (run rollups).
    """
    rows = events if with_volatile else events.where("semantic_importance <> 'VOLATILE'")
    # Types are counted before projects are, so that no group gathers its events.
    types = rows.groupBy("project_id", "event_type").agg(F.sum("aggregate_count").alias("n")).groupBy("project_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("type_counts"))
    top = F.min_by("event_id", F.struct(-F.col("importance_score"), F.col("event_id")))
    sums = rows.groupBy("project_id").agg(
        F.sum("aggregate_count").cast("long").alias("event_count"), F.sum(F.when(meaningful(), F.col("aggregate_count")).otherwise(0)).cast("long").alias("meaningful_count"),
        storage_delta().alias("storage_delta"), top.alias("top_event_id"), F.max("importance_score").alias("top_score"),
    )
    return sums.join(types, "project_id")


def run_counters(events: DataFrame) -> DataFrame:
    """Importance histogram of a run, with volatile events weighed by what they stand for."""
    return events.groupBy("semantic_importance").agg(F.count("*").alias("events"), F.sum("aggregate_count").cast("long").alias("weight"))


def snapshot(files: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Per project: files without aggregates, total size with them, newest change."""
    f = files.groupBy("project_id").agg(F.count("*").alias("file_count"), F.sum("size").alias("_s"), F.max("modified").alias("last_modified"))
    a = aggregates.groupBy("project_id").agg(F.sum("total_size").alias("_a"))
    j = f.join(a, "project_id", "full_outer")
    zero = F.lit(0)
    return j.select("project_id", F.coalesce("file_count", zero).alias("file_count"), (F.coalesce("_s", zero) + F.coalesce("_a", zero)).cast("long").alias("total_size"), "last_modified")


def snapshot_as_of(snapshots: DataFrame, target: Column) -> DataFrame:
    """The latest snapshot at or before a time; the earliest if there is none before it."""
    before = F.max_by("snapshot_id", F.when(F.col("created_at") <= target, F.struct("created_at", "snapshot_id")))
    return snapshots.agg(F.coalesce(before, F.min_by("snapshot_id", F.struct("created_at", "snapshot_id"))).alias("snapshot_id"))


def storage_growth(start: DataFrame, end: DataFrame, how: str = "inner") -> DataFrame:
    """Change in size between two project snapshots; projects of one side alone drop out unless how is full_outer."""
    a = start.select("project_id", F.col("total_size").alias("start_size"))
    b = end.select("project_id", F.col("total_size").alias("end_size"))
    out = a.join(b, "project_id", how).withColumn("growth", F.coalesce("end_size", F.lit(0)) - F.coalesce("start_size", F.lit(0)))
    return out.orderBy(F.desc(F.abs("growth")), "project_id")


def with_previous(snapshots: DataFrame, value: str) -> DataFrame:
    """Each snapshot's change against the one before it, per project."""
    w = Window.partitionBy("project_id").orderBy("created_at", "snapshot_id")
    return snapshots.withColumn("change", F.col(value) - F.lag(value).over(w))


def activity(projects: DataFrame, as_of: Column) -> DataFrame:
    """Activity of projects (asserted, lifecycle, run_events, run_score, last_meaningful): what a user says, then the lifecycle,
    then what the run brought, then the age of the last meaningful event."""
    age = F.floor((F.unix_micros(as_of) - F.unix_micros("last_meaningful")) / F.lit(86_400_000_000)).cast("long")
    user, life, run = F.col("asserted").isNotNull(), F.col("lifecycle").isin("FROZEN", "COMPLETED"), F.col("run_events") > 0
    known = F.col("last_meaningful").isNotNull()
    status = F.when(user, F.col("asserted")).when(life, F.col("lifecycle")).when(run, "ACTIVE").when(known & (age >= 30), "DORMANT").when(known & (age >= 7), "LOW_ACTIVITY").when(known, "ACTIVE").otherwise("UNKNOWN")
    score = F.when(user, 100.0).when(life, 95.0).when(run, F.least(F.lit(100.0), 45 + F.col("run_score") / 2)).when(known, F.greatest(F.lit(10.0), 70.0 - 2 * age)).otherwise(20.0)
    return projects.withColumns({"age_days": age, "status": status, "activity_score": score.cast("double")})


def activity_transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events of projects whose status has changed."""
    j = before.select("project_id", F.col("status").alias("_b")).join(after.select("project_id", F.col("status").alias("_a")), "project_id").where("_b <> _a")
    kind = F.when(F.col("_a") == "ACTIVE", "PROJECT_BECAME_ACTIVE").when(F.col("_a") == "DORMANT", "PROJECT_BECAME_DORMANT").when(F.col("_a") == "FROZEN", "PROJECT_FROZEN").when(F.col("_b") == "ACTIVE", "PROJECT_ACTIVITY_STOPPED")
    return j.select("project_id", kind.alias("event_type")).where("event_type is not null")


def retention(events: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Volatile events that aren't permanent and lie strictly more than so many days back. A plan: nothing is deleted."""
    return events.where((F.col("semantic_importance") == "VOLATILE") & ~F.col("permanent") & (F.col("occurred_at") < as_of - F.make_dt_interval(F.lit(days))))


def top_per_group(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def within_budget(rows: DataFrame, order: list[Column], cost: str, budget: int, candidates: int) -> DataFrame:
    """The best candidates whose running cost stays within a budget. Only the top `candidates` rows are ever ordered together."""
    top = rows.orderBy(*order).limit(candidates)
    spent = F.sum(cost).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("spent", spent).where(F.col("spent") <= budget)
