"""Evidence gates: single checks, statuses and how they add up. All thresholds come from the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.checks import codes_of, compare, finite, ordered_codes, relative_difference


def conservation(requests: DataFrame) -> DataFrame:
    """Scalar conservation: (check_id, source_value, target_value, metric, operator, low, high) -> measured_value, status, reason_codes.

    relative_error divides by the source's size; a zero source is 0 against a zero target, else undecided.
    """
    s, t = F.col("source_value"), F.col("target_value")
    rel = F.when(s == 0, F.when(t == 0, 0.0)).otherwise(F.abs(t - s) / F.nullif(F.abs(s), F.lit(0.0)))
    measured = F.when(finite(s) & finite(t), F.when(F.col("metric") == "absolute_error", F.abs(t - s)).otherwise(rel))
    ok = compare(F.col("measured"), F.col("operator"), F.col("low"), F.col("high"))
    out = requests.withColumn("measured", measured).withColumn("_ok", ok)
    status = F.when(F.col("measured").isNull(), "PARTIAL").when(F.col("_ok"), "PASS").otherwise("FAIL")
    codes = codes_of((F.col("measured").isNull(), "ZERO_REFERENCE_VALUE"), (F.col("measured").isNotNull() & ~F.coalesce("_ok", F.lit(False)), "CONSERVATION_CRITERION_FAILED"))
    return out.withColumn("status", status).withColumn("reason_codes", codes).withColumnRenamed("measured", "measured_value").drop("_ok")


def fairness(conditions_a: DataFrame, conditions_b: DataFrame, criteria: DataFrame) -> DataFrame:
    """Conditions (field, value, number) of two cases against criteria (field, mode, absolute, relative, reference).

    mode: exact, absolute, relative, absolute-or-relative, absolute-and-relative. A missing condition is missing and unequal.
    """
    a = conditions_a.select("field", F.col("value").alias("value_a"), F.col("number").alias("a"), F.lit(True).alias("_a"))
    b = conditions_b.select("field", F.col("value").alias("value_b"), F.col("number").alias("b"), F.lit(True).alias("_b"))
    j = criteria.join(a.join(b, "field", "full_outer"), "field", "left")
    by_abs = F.abs(F.col("a") - F.col("b")) <= F.col("absolute")
    gap = F.coalesce(*[F.when(F.col("reference") == r, relative_difference(F.col("a"), F.col("b"), r)) for r in ("case-a", "case-b", "max-absolute")])
    by_rel = gap <= F.col("relative")
    no = F.lit(False)
    ok = (
        F.when(F.col("mode") == "exact", F.col("value_a").eqNullSafe(F.col("value_b"))).when(F.col("mode") == "absolute", by_abs).when(F.col("mode") == "relative", by_rel)
        .when(F.col("mode") == "absolute-or-relative", F.coalesce(by_abs, no) | F.coalesce(by_rel, no)).when(F.col("mode") == "absolute-and-relative", F.coalesce(by_abs, no) & F.coalesce(by_rel, no))
    )
    missing = F.col("_a").isNull() | F.col("_b").isNull()
    fair = ~missing & F.coalesce(ok, no)
    return j.select("field", "mode", "value_a", "value_b", missing.alias("missing"), fair.alias("equal"), codes_of((missing, "FAIRNESS_CONDITION_MISSING"), (~fair, "FAIRNESS_CONDITION_MISMATCH")).alias("reason_codes"))


def required_gates(gates: DataFrame, group: list[str], order: str = "ord") -> DataFrame:
    """Overall status of the required gates (status, reason_codes, required) of each group.

    FAIL over PARTIAL over SKIPPED over PASS; a prefix code, then the codes of the deciding gates in order, each once.
    Under PARTIAL the codes of partial gates come before those of skipped ones. Optional gates don't count.
    """
    r, o, c = gates.where("required"), F.col(order), F.col("reason_codes")
    is_ = lambda s: F.col("status") == s
    sums = r.groupBy(*group).agg(
        F.count("*").alias("n"), *[F.count_if(is_(s)).alias(s) for s in ("FAIL", "PARTIAL", "SKIPPED")],
        *[ordered_codes(o, c, is_(s)).alias(f"c_{s}") for s in ("FAIL", "PARTIAL", "SKIPPED")],
    )
    all_skipped = (F.col("SKIPPED") > 0) & (F.col("SKIPPED") == F.col("n"))
    status = F.when(F.col("FAIL") > 0, "FAIL").when(F.col("PARTIAL") > 0, "PARTIAL").when(all_skipped, "SKIPPED").when(F.col("SKIPPED") > 0, "PARTIAL").otherwise("PASS")
    led = lambda code, *cols: F.array_distinct(F.concat(F.array(F.lit(code)), *[F.col(x) for x in cols]))
    codes = (
        F.when(F.col("FAIL") > 0, led("REQUIRED_GATE_FAILED", "c_FAIL")).when(F.col("PARTIAL") > 0, led("REQUIRED_GATE_PARTIAL", "c_PARTIAL", "c_SKIPPED"))
        .when(all_skipped, led("ALL_REQUIRED_GATES_SKIPPED", "c_SKIPPED")).when(F.col("SKIPPED") > 0, led("REQUIRED_GATE_SKIPPED", "c_SKIPPED")).otherwise(F.array().cast("array<string>"))
    )
    return sums.select(*group, status.alias("status"), codes.alias("reason_codes"))


def merge_readiness(states: DataFrame, group: list[str], order: str = "ord") -> DataFrame:
    """FAIL over PARTIAL (skipped counts as such) over PASS, with the codes of the deciding states and no prefix."""
    failed, partial = F.col("status") == "FAIL", F.col("status").isin("PARTIAL", "SKIPPED")
    o, c = F.col(order), F.col("reason_codes")
    sums = states.groupBy(*group).agg(F.count_if(failed).alias("f"), F.count_if(partial).alias("p"), ordered_codes(o, c, failed).alias("cf"), ordered_codes(o, c, partial).alias("cp"))
    return sums.select(
        *group, F.when(F.col("f") > 0, "FAIL").when(F.col("p") > 0, "PARTIAL").otherwise("PASS").alias("status"),
        F.when(F.col("f") > 0, F.col("cf")).when(F.col("p") > 0, F.col("cp")).otherwise(F.array().cast("array<string>")).alias("reason_codes"),
    )


def regressions(records: DataFrame) -> DataFrame:
    """Records (regression_id, status, reason_codes, authorized, exit_code, executed_at, actual_ref) -> evaluated status and codes."""
    bad_exit = F.coalesce(F.col("exit_code") != 0, F.lit(False))
    holes = F.col("executed_at").isNull() | F.col("exit_code").isNull() | F.col("actual_ref").isNull()
    s, c = F.col("status"), F.col("reason_codes")
    one = lambda x: F.array(F.lit(x))
    status = F.when(~F.col("authorized"), "FAIL").when((s == "FAIL") | bad_exit, "FAIL").when(s.isin("PARTIAL", "SKIPPED") | holes, "PARTIAL").otherwise("PASS")
    codes = (
        F.when(~F.col("authorized"), one("UNAUTHORIZED_REGRESSION_RECORD")).when((s == "FAIL") & bad_exit, F.array_distinct(F.concat(c, one("UPSTREAM_RUN_FAILED")))).when(s == "FAIL", F.array_distinct(c))
        .when(bad_exit, one("UPSTREAM_RUN_FAILED")).when(s.isin("PARTIAL", "SKIPPED"), F.array_distinct(c)).when(holes, one("REGRESSION_RECORD_INCOMPLETE")).otherwise(F.array().cast("array<string>"))
    )
    return records.select("regression_id", status.alias("status"), codes.alias("reason_codes"))


def connectivity_verdict(connected: Column, expected: Column) -> tuple[Column, Column]:
    """Status and codes of a connectivity check."""
    ok = connected == expected
    return F.when(ok, "PASS").otherwise("FAIL"), codes_of((~ok & expected, "DISCONNECTED_TOPOLOGY"), (~ok & ~expected, "UNEXPECTED_CONNECTED_TOPOLOGY"))


def verify_package(artifacts: DataFrame, present: DataFrame) -> DataFrame:
    """Artifacts (artifact_id, path, sha256, external) against files (path, sha256): status and codes."""
    j = artifacts.join(present.select("path", F.col("sha256").alias("_found")), "path", "left")
    gone, differs = F.col("_found").isNull(), F.col("_found") != F.col("sha256")
    status = F.when(F.col("external"), "PARTIAL").when(gone | differs, "FAIL").otherwise("PASS")
    codes = F.when(F.col("external"), F.array(F.lit("EXTERNAL_ARTIFACT_NOT_RESOLVED"))).when(gone, F.array(F.lit("MISSING_REQUIRED_FILE"))).when(differs, F.array(F.lit("HASH_MISMATCH"))).otherwise(F.array().cast("array<string>"))
    return j.select("artifact_id", "path", status.alias("status"), codes.alias("reason_codes"))


def select_inventory(selection: DataFrame, inventory: DataFrame) -> DataFrame:
    """Selected assets with their audited hashes; missing rows and unhashed files are reported, not dropped."""
    inv = inventory.select("path", "sha256", "hash_status", F.lit(True).alias("_in"))
    j = selection.join(inv, "path", "left")
    state = F.when(F.col("_in").isNull(), "NOT_IN_INVENTORY").when(F.col("hash_status") != "PASS", "HASH_NOT_AUDITED").otherwise("SELECTED")
    return j.select("path", "sha256", state.alias("selection_state"))
