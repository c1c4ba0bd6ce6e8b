"""Handoffs: reviews and records become states, states a readiness, and packages are checked against their manifests.

Records of many handoffs are judged at once; nothing is run, approved or changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators import gates

# Words of roles that no person has; the one supported way of mapping.
AUTOMATED_ROLES = ["agent", "ai", "automation", "automated", "bot", "codex", "machine"]
MAPPING_METHOD = "area-overlap-piecewise-constant"


def _codes(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")


def scope_reviews(reviews: DataFrame, audits: DataFrame, key: str = "handoff_id") -> DataFrame:
    """(key, status, reason_codes, valid): human reviews of what an audit couldn't see.

    reviews: (key, decision, reviewer_role, reviewed, accepted, blocked). audits: (key, status, reason_codes). A failed audit stays failed whatever a review
    says; a rejection fails; blocked items fail; every reason of the audit must have been reviewed, and a partial audit needs
    accepted exclusions. Reviews by automated roles, or with another decision, are not valid and have no status.
    """
    j = reviews.join(audits.select(key, F.col("status").alias("_s"), F.col("reason_codes").alias("_r")), key)
    words = F.split(F.trim(F.regexp_replace(F.lower("reviewer_role"), r"[-_\s]+", " ")), " ")
    valid = F.coalesce((F.trim("reviewer_role") != "") & ~F.arrays_overlap(words, _codes(*AUTOMATED_ROLES)) & F.col("decision").isin("accepted", "rejected") & (F.size("reviewed") > 0), F.lit(False))
    missing = F.array_except("_r", "reviewed")
    blocked, s = F.size("blocked") > 0, F.col("_s")
    incomplete = (F.size(missing) > 0) | ((s == "PARTIAL") & (F.size("accepted") == 0))
    status = F.when(s == "FAIL", "FAIL").when(s == "SKIPPED", "PARTIAL").when((F.col("decision") == "rejected") | blocked, "FAIL").when(incomplete, "PARTIAL").otherwise("PASS")
    codes = (
        F.when(s == "FAIL", F.concat("_r", _codes("UPSTREAM_AUDIT_FAILED"))).when(s == "SKIPPED", F.concat("_r", _codes("UPSTREAM_AUDIT_INCOMPLETE")))
        .when((F.col("decision") == "rejected") & blocked, _codes("SCOPE_REVIEW_REJECTED")).when(F.col("decision") == "rejected", _codes("SCOPE_REVIEW_REJECTED", "SCOPE_REVIEW_INCOMPLETE"))
        .when(blocked, _codes("SCOPE_REVIEW_HAS_BLOCKED_ITEMS")).when(incomplete, _codes("SCOPE_REVIEW_INCOMPLETE")).otherwise(_codes())
    )
    return j.select(key, F.when(valid, status).alias("status"), F.when(valid, F.array_distinct(codes)).otherwise(_codes()).alias("reason_codes"), valid.alias("valid"))


def audit_states(audits: DataFrame, reviewed: DataFrame, key: str = "handoff_id") -> DataFrame:
    """(key, status, reason_codes): the audit's state, which a valid review may stand in for."""
    r = reviewed.where("valid").select(key, F.col("status").alias("_rs"), F.col("reason_codes").alias("_rc"))
    j = audits.join(r, key, "left")
    s, c, has = F.col("status"), F.col("reason_codes"), F.col("_rs").isNotNull()
    status = F.when(s.isin("PASS", "FAIL"), s).when(has, F.col("_rs")).otherwise("PARTIAL")
    codes = F.when(s == "PASS", _codes()).when(s == "FAIL", F.concat(c, _codes("UPSTREAM_AUDIT_FAILED"))).when(has, F.when(F.col("_rs") == "PASS", _codes()).otherwise(F.col("_rc"))).otherwise(F.concat(c, _codes("UPSTREAM_AUDIT_INCOMPLETE")))
    return j.select(key, status.alias("status"), codes.alias("reason_codes"))


def _states(rows: DataFrame, status: str, failed: str, incomplete: str, key: str, order: str) -> DataFrame:
    s, given = F.col(status), F.size("reason_codes") > 0
    out = rows.where(s.isin("FAIL", "PARTIAL", "SKIPPED"))
    codes = F.when(given, F.col("reason_codes")).otherwise(F.array(F.when(s == "FAIL", failed).otherwise(incomplete)))
    return gates.merge_readiness(out.select(key, F.col(order).alias("ord"), F.when(s == "FAIL", "FAIL").otherwise("PARTIAL").alias("status"), codes.alias("reason_codes")), [key])


def output_states(outputs: DataFrame, key: str = "handoff_id", order: str = "artifact_id") -> DataFrame:
    """(key, status, reason_codes) of handoffs with outputs (key, order, status, reason_codes) that haven't passed; all others pass."""
    return _states(outputs, "status", "UPSTREAM_OUTPUT_FAILED", "UPSTREAM_OUTPUT_INCOMPLETE", key, order)


def dependency_states(dependencies: DataFrame, key: str = "handoff_id", order: str = "dependency_id") -> DataFrame:
    """The same of private dependencies (key, order, required, availability_status, reason_codes); optional ones don't count."""
    return _states(dependencies.where("required"), "availability_status", "PRIVATE_DEPENDENCY_MISSING", "PRIVATE_DEPENDENCY_UNVERIFIED", key, order)


def regression_states(records: DataFrame, handoffs: DataFrame, key: str = "handoff_id") -> DataFrame:
    """handoffs (key, require_regression), records (key, and the columns of gates.regressions): the merged state of each; none at all is a state of its own."""
    judged = gates.regressions(records.withColumn("regression_id", F.struct(key, "regression_id"))).select(F.col(f"regression_id.{key}").alias(key), F.col("regression_id.regression_id").alias("ord"), "status", "reason_codes")
    merged = gates.merge_readiness(judged, [key]).select(key, F.col("status").alias("_s"), F.col("reason_codes").alias("_c"))
    j = handoffs.select(key, "require_regression").join(merged, key, "left")
    bare = F.col("_s").isNull()
    status = F.when(~bare, F.col("_s")).when(F.col("require_regression"), "PARTIAL").otherwise("PASS")
    codes = F.when(~bare, F.col("_c")).when(F.col("require_regression"), _codes("MISSING_REGRESSION_RECORD")).otherwise(_codes())
    return j.select(key, status.alias("status"), codes.alias("reason_codes"))


def readiness(*states: DataFrame, key: str = "handoff_id") -> DataFrame:
    """States of several sources, in the order given, merged per handoff."""
    out = None
    for i, s in enumerate(states):
        one = s.select(key, F.lit(i).alias("ord"), "status", "reason_codes")
        out = one if out is None else out.unionByName(one)
    return gates.merge_readiness(out, [key])


def entrypoint_states(entrypoints: DataFrame, present: DataFrame, key: str = "handoff_id") -> DataFrame:
    """entrypoints (key, ord, path, external) of packages, present (key, path): what is external can't be told, what isn't there fails."""
    j = entrypoints.join(present.select(key, "path", F.lit(True).alias("_in")), [key, "path"], "left")
    codes = F.when(F.col("external"), _codes("EXTERNAL_ENTRYPOINT_NOT_RESOLVED")).otherwise(_codes("MISSING_ENTRYPOINT"))
    state = F.when(F.col("external"), "PARTIAL").when(F.col("_in").isNull(), "FAIL")
    return j.select(key, "ord", state.alias("status"), codes.alias("reason_codes")).where("status is not null")


def package_states(artifacts: DataFrame, entrypoints: DataFrame, present: DataFrame, others: DataFrame, key: str = "handoff_id") -> DataFrame:
    """The state of whole packages: artifacts (key, ord, path, sha256, external) by hash, entrypoints, and what the manifest (others: key, ord, status, reason_codes) brings along."""
    j = artifacts.join(present.select(key, "path", F.col("sha256").alias("_found")), [key, "path"], "left")
    gone, differs = F.col("_found").isNull(), F.lower("_found") != F.lower("sha256")
    status = F.when(F.col("external"), "PARTIAL").when(gone | differs, "FAIL").otherwise("PASS")
    codes = F.when(F.col("external"), _codes("EXTERNAL_ARTIFACT_NOT_RESOLVED")).when(gone, _codes("MISSING_REQUIRED_FILE")).when(differs, _codes("HASH_MISMATCH")).otherwise(_codes())
    at = lambda df, n: df.select(key, F.struct(F.lit(n).alias("part"), F.col("ord").cast("string").alias("ord")).alias("ord"), "status", "reason_codes")
    checks = j.select(key, "ord", status.alias("status"), codes.alias("reason_codes"))
    return gates.merge_readiness(at(checks, 0).unionByName(at(entrypoint_states(entrypoints, present, key), 1)).unionByName(at(others, 2)), [key])


# Fields: the stages of a mapping, and its manifest


def mapping_support(requests: DataFrame) -> DataFrame:
    """requests (mapping_id, method, outside_domain_policy, missing_value_policy, grid_types, centerings): SKIPPED with codes beyond what is supported, else null."""
    bad = lambda c, code: F.when(c, F.lit(code))
    codes = F.filter(F.array(
        bad(F.col("method") != MAPPING_METHOD, "UNSUPPORTED_MAPPING_METHOD"), bad(F.col("outside_domain_policy") != "reject", "UNSUPPORTED_OUTSIDE_DOMAIN_POLICY"), bad(F.col("missing_value_policy") != "reject", "UNSUPPORTED_MISSING_VALUE_POLICY"),
        bad(F.exists("grid_types", lambda x: x != "regular_2d"), "UNSUPPORTED_GRID_TYPE"), bad(F.exists("centerings", lambda x: x != "cell"), "UNSUPPORTED_GRID_CENTERING"),
    ), lambda x: x.isNotNull())
    return requests.select("mapping_id", F.when(F.size(codes) > 0, "SKIPPED").alias("status"), codes.alias("reason_codes"))


def unsupported_status(codes: Column) -> Column:
    """SKIPPED where all reasons say that something is not supported, else FAIL; PASS without reasons."""
    return F.when(F.size(codes) == 0, "PASS").when(F.forall(codes, lambda x: F.startswith(x, F.lit("UNSUPPORTED_"))), "SKIPPED").otherwise("FAIL")


def input_identity(sources: DataFrame) -> DataFrame:
    """sources (mapping_id, actual_sha256, expected_sha256, columns, axis_order, source_units, target_units, source_sign, target_sign, component, value_column, table_codes, and unsupported):
    the first gate of a mapping, with the codes of its declarations before those of its table."""
    bad = lambda c, code: F.when(F.coalesce(c, F.lit(True)), F.lit(code))
    own = F.filter(F.array(
        bad(F.lower("actual_sha256") != F.lower("expected_sha256"), "SOURCE_HASH_MISMATCH"), bad(F.col("columns") != F.col("axis_order"), "AXIS_ORDER_MISMATCH"), bad(F.col("source_units") != F.col("target_units"), "FIELD_UNIT_MISMATCH"),
        bad(F.col("source_sign") != F.col("target_sign"), "SIGN_CONVENTION_MISMATCH"), bad(F.col("component") != F.col("value_column"), "FIELD_COMPONENT_COLUMN_MISMATCH"),
    ), lambda x: x.isNotNull())
    codes = F.array_distinct(F.concat("unsupported", own, "table_codes"))
    return sources.select("mapping_id", unsupported_status(codes).alias("status"), codes.alias("reason_codes"))


def manifest_release(mappings: DataFrame, stages: DataFrame, gate_ids: DataFrame) -> DataFrame:
    """Which mappings may be released: (mapping_id, released, reason).

    mappings: (mapping_id, output_sha256, reported_sha256). stages: (mapping_id, gate_id, status), four of them that pass. gate_ids: (mapping_id, gate_id), those of the gate report,
    which has every stage's. Reasons in the order in which they rule it out.
    """
    s = stages.groupBy("mapping_id").agg(F.count("*").alias("_n"), F.count_if(F.col("status") != "PASS").alias("_bad"))
    lost = stages.join(gate_ids, ["mapping_id", "gate_id"], "left_anti").groupBy("mapping_id").agg(F.count("*").alias("_lost"))
    j = mappings.join(s, "mapping_id", "left").join(lost, "mapping_id", "left")
    reason = (
        F.when((F.coalesce("_n", F.lit(0)) != 4) | (F.col("_bad") > 0), "STAGE_NOT_PASSED").when(F.col("_lost") > 0, "STAGE_GATE_MISSING")
        .when(F.col("output_sha256").isNotNull() & ~F.col("output_sha256").eqNullSafe(F.col("reported_sha256")), "OUTPUT_HASH_MISMATCH")
    )
    return j.select("mapping_id", reason.isNull().alias("released"), reason.alias("reason"))
