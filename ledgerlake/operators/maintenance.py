"""One maintenance run: two catalog states and the identities between them become events, alerts and a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators.changes import GIB, MIB
from ledgerlake.operators.projects import IMPORTANT_AUTHORITIES

# Roles whose loss is an alert, roles of models, and words of places that keep copies.
IMPORTANT_ROLES = ["canonical_model", "final", "deliverable", "manuscript", "presentation", "raw_data", "source", "recovery"]
MODEL_ROLES = ["working_model", "canonical_model"]
KEPT_WORDS = "archive|handoff|backup|历史|归档"


def surviving_copies(missing: DataFrame, present: DataFrame) -> DataFrame:
    """missing (path_key, size, sha256, sample) with the surest surviving copy: by full hash before sample, the first path of either.

    Groups of copies are reduced to their first path before they meet anything.
    """
    full = present.where("sha256 is not null").groupBy("size", "sha256").agg(F.min("path_key").alias("_full"))
    part = present.where("sample is not null").groupBy("size", "sample").agg(F.min("path_key").alias("_part"))
    j = missing.join(full, ["size", "sha256"], "left").join(part, ["size", "sample"], "left")
    return j.select("path_key", F.coalesce("_full", "_part").alias("survivor"), F.col("_full").isNotNull().alias("verified"))


def maintenance_events(changes: DataFrame, transitions: DataFrame, assets: DataFrame, copies: DataFrame, here: DataFrame) -> DataFrame:
    """All events of a run: (path_key, source_path_key, event_type, size_delta, resolution_status).

    changes: (path_key, change_type, before_size, after_size, volatile_class). transitions: (event_type, source_path_key, target_path_key), one at most for
    each source and target. assets: (path_key, role, authority_level, superseded_by), of both states. copies: of surviving_copies(). here: (path_key) of what is present.

    Sources of moves make no events of their own. Targets of moves, renames and copies make that event, and one each for a role or
    an authority that has become another; a possible move is an event beside the change's own. A missing file is resolved by a surviving copy, or else,
    if it is important and nothing present supersedes it, makes an alert. Volatile changes become one event a class.
    """
    role = lambda p: assets.select(F.col("path_key").alias(f"{p}_path_key"), F.col("role").alias(f"{p}_role"), F.col("authority_level").alias(f"{p}_authority"))
    t = transitions.withColumnRenamed("event_type", "way").join(role("source"), "source_path_key", "left").join(role("target"), "target_path_key", "left")
    t = t.withColumnRenamed("target_path_key", "path_key")
    left = transitions.where("event_type in ('MOVED', 'RENAMED')").select(F.col("source_path_key").alias("path_key"))
    lasting = changes.where("volatile_class is null").join(left, "path_key", "left_anti").join(t, "path_key", "left")
    own = assets.join(here.select(F.col("path_key").alias("superseded_by"), F.lit(True).alias("_kept")), "superseded_by", "left").select("path_key", "role", "authority_level", "_kept")
    lasting = lasting.join(own, "path_key", "left").join(copies, "path_key", "left")

    b, a, kind, way = F.coalesce("before_size", F.lit(0)), F.coalesce("after_size", F.lit(0)), F.col("change_type"), F.col("way")
    d = a - b
    sure, moved = F.coalesce(way.isin("MOVED", "RENAMED", "COPIED"), F.lit(False)), F.coalesce(way.isin("MOVED", "RENAMED"), F.lit(False))
    new, changed, gone = ~sure & (kind == "NEW"), ~sure & (kind == "CHANGED"), ~sure & (kind == "MISSING")
    big = (a >= GIB) | (F.col("role").isin(MODEL_ROLES) & (a >= GIB // 4))
    step = (F.abs(d) >= 64 * MIB) | (F.abs(d) * 4 >= F.greatest(F.lit(1), b))
    survivor = F.col("survivor").isNotNull()
    kept = F.when(F.rlike(F.lower("survivor"), F.lit(KEPT_WORDS)), "archived_copy_").otherwise("content_copy_")
    resolution = F.when(survivor, F.concat(kept, F.when(F.col("verified"), "verified").otherwise("candidate"))).otherwise("unresolved_missing")
    important = F.coalesce(F.col("authority_level").isin(IMPORTANT_AUTHORITIES), F.lit(False)) | F.coalesce(F.col("role").isin(IMPORTANT_ROLES), F.lit(False))
    zero, none = F.lit(0), F.lit(None).cast("string")

    def event(when: Column, name, delta: Column = zero, status=none) -> Column:
        name, status = (F.lit(x) if isinstance(x, str) else x for x in (name, status))
        return F.when(when, F.struct(name.alias("event_type"), delta.cast("long").alias("size_delta"), status.alias("resolution_status")))

    made = F.array(
        event(sure, F.concat(F.lit("FILE_"), way), zero, "identity_resolved"), event(F.coalesce(way == "POSSIBLE_MOVE", F.lit(False)), "POSSIBLE_MOVE", zero, "unverified_candidate"),
        event(moved & ~F.col("source_role").eqNullSafe(F.col("target_role")), "ROLE_CHANGED"), event(moved & ~F.col("source_authority").eqNullSafe(F.col("target_authority")), "AUTHORITY_CHANGED"),
        event(new, "FILE_CREATED", a), event(new & F.coalesce(big, F.lit(False)), "LARGE_ASSET_CREATED"), event(~sure & (kind == "REAPPEARED"), "FILE_REAPPEARED", a),
        event(changed, "FILE_CHANGED", d), event(changed & step & (d > 0), "FILE_SIZE_GROWTH", d), event(changed & step & (d < 0), "FILE_SIZE_SHRINK", d),
        event(gone, "FILE_MISSING", -b, resolution), event(gone & (b >= GIB), "LARGE_ASSET_REMOVED", zero, "unresolved_missing"),
        event(gone & important & ~survivor & F.col("_kept").isNull(), "POSSIBLE_ASSET_LOSS", zero, "open_alert"),
    )
    own = lasting.select("path_key", "source_path_key", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("e")).select("path_key", "source_path_key", "e.*")
    delta = F.coalesce("after_size", zero) - F.coalesce("before_size", zero)
    classes = changes.where("volatile_class is not null").groupBy("volatile_class").agg(F.sum(delta).cast("long").alias("size_delta"))
    volatile = classes.select(F.concat(F.lit("volatile:"), "volatile_class").alias("path_key"), none.alias("source_path_key"), F.lit("VOLATILE_CHANGE_AGGREGATE").alias("event_type"), "size_delta", none.alias("resolution_status"))
    return own.unionByName(volatile)


def alerts_after(open_alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Alerts (path_key, status) after a run: losses open one, files that come back, or are found elsewhere, close theirs."""
    back = events.where("event_type in ('FILE_REAPPEARED', 'FILE_MOVED', 'FILE_RENAMED', 'FILE_COPIED')").select(F.explode(F.array("path_key", "source_path_key")).alias("path_key")).where("path_key is not null").distinct()
    lost = events.where("event_type = 'POSSIBLE_ASSET_LOSS'").select("path_key", F.lit("OPEN").alias("status")).distinct()
    had = open_alerts.join(lost.select("path_key"), "path_key", "left_anti").join(back.withColumn("_back", F.lit(True)), "path_key", "left")
    return had.select("path_key", F.when(F.col("_back"), "RESOLVED").otherwise(F.col("status")).alias("status")).unionByName(lost)


def global_snapshot(files: DataFrame, aggregates: DataFrame, assets: DataFrame, projects: DataFrame) -> DataFrame:
    """One row for the whole catalog: files and aggregates together, what could be cleaned up or archived, projects and authorities."""
    key = F.lit(1).alias("_k")
    n = lambda c: F.count_if(c).cast("long")
    here = files.where("status = 'present'")
    f = here.agg(F.count("*").alias("_n"), F.coalesce(F.sum("size"), F.lit(0)).alias("_s"), F.max("modified").alias("last_modified")).select("*", key)
    g = aggregates.agg(F.coalesce(F.sum("file_count"), F.lit(0)).alias("_an"), F.coalesce(F.sum("total_size"), F.lit(0)).alias("_as")).select("*", key)
    a = assets.agg(n(F.col("authority_level").isin(IMPORTANT_AUTHORITIES)).alias("authority_asset_count")).select("*", key)
    r = assets.where(F.col("archive_recommendation").like("REVIEW_%")).join(here, "path_key").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("potential_archive")).select("*", key)
    p = projects.agg(F.count("*").alias("project_count"), n(F.col("activity_status") == "ACTIVE").alias("active_projects"), n(F.col("activity_status").isin("FROZEN", "COMPLETED")).alias("frozen_projects")).select("*", key)
    out = f
    for part in (g, a, r, p):
        out = out.join(F.broadcast(part), "_k")  # one row each
    return out.select(
        (F.col("_n") + F.col("_an")).cast("long").alias("files_count"), (F.col("_s") + F.col("_as")).cast("long").alias("logical_size"), "last_modified", F.col("_as").cast("long").alias("aggregate_size"),
        F.col("_as").cast("long").alias("potential_cleanup"), "potential_archive", "authority_asset_count", "project_count", "active_projects", "frozen_projects",
    )


def daily_snapshots_to_drop(snapshots: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Daily snapshots strictly older than so many days; weekly and monthly ones stay. A plan: nothing is deleted."""
    return snapshots.where((F.col("snapshot_kind") == "daily") & (F.col("created_at") < as_of - F.make_dt_interval(F.lit(days))))


def since_last_run(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Events of the last maintenance run, of either kind."""
    last = runs.where("mode in ('MAINTENANCE', 'WEEKLY_DEEP_MAINTENANCE')").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))
    return events.join(F.broadcast(last), "run_id")  # one row


# Assertions: what users say is kept as a table of its own and replaced by rewriting.


def set_assertions(table: DataFrame, said: DataFrame) -> DataFrame:
    """table, said: (subject_type, subject_key, predicate, value, active, updated_at). What is said replaces what stands for the same subject and predicate."""
    key = ["subject_type", "subject_key", "predicate"]
    return table.join(said.select(*key), key, "left_anti").unionByName(said)


def remove_assertions(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Marks assertions as inactive; they stay in the table."""
    key = ["subject_type", "subject_key", "predicate"]
    j = table.join(keys.select(*key, F.lit(True).alias("_gone")), key, "left")
    return j.withColumn("active", F.col("active") & F.col("_gone").isNull()).select(*table.columns)


def active_assertions(table: DataFrame) -> DataFrame:
    return table.where("active").orderBy("updated_at", "subject_type", "subject_key", "predicate")
