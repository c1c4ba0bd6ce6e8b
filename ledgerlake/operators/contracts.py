"""Contracts over many records at once: keys, uniqueness, references. Each rule is a query for what breaks it; no rows, no breach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_violations(records: DataFrame, record: str, keys: str, required: list[str], optional: list[str] | None = None) -> DataFrame:
    """records (record, keys array<string>): (record, violation, key) for keys that are missing, and for those that aren't known."""
    must, may = F.array(*[F.lit(k) for k in required]), F.array(*[F.lit(k) for k in [*required, *(optional or [])]])
    both = F.concat(F.transform(F.array_except(must, keys), lambda k: F.struct(F.lit("MISSING_KEY").alias("violation"), k.alias("key"))), F.transform(F.array_except(keys, may), lambda k: F.struct(F.lit("UNKNOWN_KEY").alias("violation"), k.alias("key"))))
    return records.select(record, F.explode(both).alias("v")).select(record, "v.*")


def repeated(rows: DataFrame, scope: list[str], value: str, violation: str = "REPEATED_VALUE") -> DataFrame:
    """Values that are there more than once in their scope."""
    return rows.groupBy(*scope, value).agg(F.count("*").alias("n")).where("n > 1").withColumn("violation", F.lit(violation))


def dangling(rows: DataFrame, targets: DataFrame, on: list[str], violation: str = "UNKNOWN_REFERENCE") -> DataFrame:
    """References that nothing answers to: an anti join."""
    return rows.join(targets.select(*on).distinct(), on, "left_anti").withColumn("violation", F.lit(violation))


def covers(expected: DataFrame, found: DataFrame, group: str, value: str) -> DataFrame:
    """(group, covered): whether each group's expected values are all among those found."""
    lost = expected.join(found.select(group, value).distinct(), [group, value], "left_anti").groupBy(group).agg(F.count("*").alias("_lost"))
    return expected.select(group).distinct().join(lost, group, "left").select(group, F.col("_lost").isNull().alias("covered"))


def breaches(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """One row for each row and rule (violation, condition that must hold) that it breaks; null is a breach."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    return rows.withColumn("violation", F.explode(broken))
