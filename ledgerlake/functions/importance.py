"""Importance of events: an additive score, its class, and what is kept for good."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base score of an event type; 10 for any other.
BASE_SCORES = {
    "POSSIBLE_ASSET_LOSS": 58, "IMPORTANT_ASSET_ALERT": 58, "AUTHORITY_CHANGED": 48, "FILE_MISSING": 28,
    "LARGE_ASSET_CREATED": 32, "LARGE_ASSET_REMOVED": 36, "FILE_MOVED": 22, "FILE_RENAMED": 20, "FILE_CHANGED": 40,
    "FILE_CREATED": 14, "FILE_COPIED": 12, "PROJECT_BECAME_ACTIVE": 42, "PROJECT_BECAME_DORMANT": 42,
    "WORKSTREAM_STATUS_CHANGED": 24, "DEPENDENCY_ADDED": 10, "DEPENDENCY_REMOVED": 12, "AGGREGATE_SIZE_GROWTH": 14, "AGGREGATE_CREATED": 12,
}
# Authority bonuses, important roles, storage event types.
AUTHORITY_SCORES = {"CANONICAL": 30, "PRIMARY": 26, "ACTIVE": 20}
IMPORTANT_ROLES = ["canonical_model", "final", "deliverable", "manuscript", "presentation", "raw_data", "source", "recovery"]
STORAGE_EVENT_TYPES = [
    "FILE_CREATED", "FILE_REAPPEARED", "FILE_MISSING", "FILE_CHANGED",
    "AGGREGATE_CREATED", "AGGREGATE_REMOVED", "AGGREGATE_SIZE_GROWTH", "AGGREGATE_SIZE_SHRINK",
]
GIB = 1 << 30


def _lookup(x: Column, table: dict[str, int], default: int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), x), F.lit(default))


def score(event_type: Column, authority: Column, role: Column, size: Column, dependents: Column, rebuildable: Column, explicit_user: Column, volatile: Column) -> Column:
    authority, role, n = F.coalesce(authority, F.lit("")), F.coalesce(role, F.lit("")), F.coalesce(dependents, F.lit(0))
    by_role = F.when(role.isin(IMPORTANT_ROLES), F.when(role.isin("canonical_model", "manuscript", "raw_data"), 18).otherwise(12)).when((event_type == "FILE_COPIED") & (role == "working_model"), 28).otherwise(0)
    by_size = F.when(size >= 4 * GIB, 18).when(size >= GIB, 12).when(size >= GIB // 4, 7).otherwise(0)
    by_use = F.when(n > 0, F.least(F.lit(12.0), 2 + 2 * F.log2(n + F.lit(1.0)))).otherwise(0.0)
    total = _lookup(event_type, BASE_SCORES, 10) + _lookup(authority, AUTHORITY_SCORES, 0) + by_role + by_size + by_use
    total = total - F.when(rebuildable, 12).otherwise(0) + F.when(explicit_user, 20).otherwise(0)
    return F.when(F.coalesce(volatile, F.lit(False)), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total.cast("double"))), 2))


def importance(score: Column, volatile: Column) -> Column:
    return F.when(F.coalesce(volatile, F.lit(False)), "VOLATILE").when(score >= 85, "VERY_HIGH").when(score >= 65, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW")


def permanent(importance: Column, event_type: Column) -> Column:
    return importance.isin("VERY_HIGH", "HIGH") | event_type.isin("POSSIBLE_ASSET_LOSS", "AUTHORITY_CHANGED")
