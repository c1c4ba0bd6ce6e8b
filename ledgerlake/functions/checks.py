"""Comparisons with declared criteria, and statuses with ordered reason codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def compare(value: Column, operator: Column, low: Column, high: Column | None = None) -> Column:
    """lt, lte, eq, gte, gt against low; between low and high, ends included. Null for unknown operators or non-finite values."""
    high = F.lit(None).cast("double") if high is None else high
    out = (
        F.when(operator == "lt", value < low).when(operator == "lte", value <= low).when(operator == "eq", value == low)
        .when(operator == "gte", value >= low).when(operator == "gt", value > low).when(operator == "between", (value >= low) & (value <= high))
    )
    return F.when(finite(value), out)


def compare_declared(value: Column, operator: Column, low: Column, high: Column | None = None) -> Column:
    """The comparison as text: true or false, ERROR for an operator that isn't known; null for values that are not finite."""
    known = operator.isin("lt", "lte", "eq", "gte", "gt", "between")
    return F.when(F.coalesce(known, F.lit(False)), compare(value, operator, low, high).cast("string")).otherwise("ERROR")


def close(a: Column, b: Column, scale: Column | float = 1.0) -> Column:
    s = F.lit(float(scale)) if isinstance(scale, (int, float)) else scale
    return F.abs(a - b) <= 1e-10 * F.greatest(s, F.abs(a), F.abs(b), F.lit(1.0))


def relative_difference(a: Column, b: Column, reference: str) -> Column:
    base = {"case-a": F.abs(a), "case-b": F.abs(b), "max-absolute": F.greatest(F.abs(a), F.abs(b))}[reference]
    return F.when(base == 0, F.when(a == b, 0.0)).otherwise(F.abs(a - b) / F.nullif(base, F.lit(0.0)))


def ordered_codes(order: Column, codes: Column, when: Column) -> Column:
    """Aggregate: the reason codes of the chosen rows, in order, each once."""
    held = F.array_sort(F.collect_list(F.when(when, F.struct(order.alias("o"), codes.alias("c")))))
    return F.array_distinct(F.flatten(F.transform(held, lambda x: x["c"])))


def codes_of(*cases: tuple[Column, str]) -> Column:
    """The codes of the conditions that hold, in the order given."""
    return F.filter(F.array(*[F.when(c, code) for c, code in cases]), lambda x: x.isNotNull())
