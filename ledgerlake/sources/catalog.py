"""A catalog: a folder of Parquet tables with versions. Loads replace whole tables; older versions stay until they are dropped, so a load can be taken back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import hadoop_path, json_document, write_json

SCHEMA_VERSION = 3
SCHEMAS = {
    "files": "path_key string, path string, root_path string, size long, modified string, status string, project_id string, file_id string, sample_fingerprint string, full_sha256 string, is_communication boolean, volatile_class string",
    "projects": "project_id string, name string, file_count long, total_size long, status string, root_path string, purpose string, lifecycle string, confidence double",
    "assets": "path_key string, project_id string, role string, authority_level string, confidence double, archive_recommendation string, superseded_by string, workstream_id string, authority_scope string",
    "events": "event_id string, event_type string, occurred_at timestamp, project_id string, path_key string, size_delta long, semantic_importance string, importance_score double, permanent boolean, run_id string",
    "alerts": "alert_id string, path_key string, project_id string, status string, first_seen timestamp",
    "snapshots": "snapshot_id string, created_at timestamp, snapshot_kind string, files_count long, logical_size long",
    "assertions": "subject_type string, subject_key string, predicate string, value string, active boolean, updated_at timestamp",
}


class Catalog:
    """Tables below a folder that driver and executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        fs, at = hadoop_path(spark, f"{self.path}/catalog.json")
        if not fs.exists(at):
            self._save({"schema_version": SCHEMA_VERSION, "tables": {}})

    def _state(self) -> dict:
        return json_document(self.spark, f"{self.path}/catalog.json")

    def _save(self, state: dict) -> None:
        write_json(state, f"{self.path}/catalog.json", self.spark)

    def versions(self, table: str) -> list[int]:
        return self._state()["tables"].get(table, {}).get("versions", [])

    def read(self, table: str) -> DataFrame:
        """The current version; an empty table before the first load. Columns that a version was written without are null."""
        schema = T._parse_datatype_string(SCHEMAS[table])
        held = self._state()["tables"].get(table)
        if not held:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}/{held['versions'][-1]}")

    def replace(self, table: str, rows: DataFrame) -> None:
        """A new version of the whole table, which may be made from the current one: that isn't touched."""
        have = set(rows.columns)
        fields = T._parse_datatype_string(SCHEMAS[table]).fields
        cols = [(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
        version = max(self.versions(table), default=0) + 1
        rows.select(*cols).write.mode("overwrite").parquet(f"{self.path}/{table}/{version}")
        state = self._state()
        state["tables"].setdefault(table, {"versions": []})["versions"].append(version)
        self._save(state)

    def rollback(self, table: str) -> None:
        """Takes the last load back."""
        state = self._state()
        held = state["tables"].get(table, {"versions": []})["versions"]
        if len(held) < 2:
            raise ValueError(f"{table} has no earlier version")
        held.pop()
        self._save(state)

    def migrate(self) -> dict:
        """Rewrites tables for the present schema, with a new version each; what was before can be had back by rollback(). Returns what was done."""
        state = self._state()
        done = {"from": state["schema_version"], "to": SCHEMA_VERSION, "tables": []}
        if state["schema_version"] == SCHEMA_VERSION:
            return done
        for table in sorted(state["tables"]):
            self.replace(table, self.read(table))
            done["tables"].append(table)
        state = self._state()
        state["schema_version"] = SCHEMA_VERSION
        self._save(state)
        return done
