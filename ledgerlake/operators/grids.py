"""Scalar fields on regular two-dimensional grids: validation, normalisation, conservative re-gridding, integrals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.checks import close, codes_of, compare


@dataclass(frozen=True)
class Grid:
    """Cell-centred: cells per axis, spacing, and the lower corner."""

    shape: tuple[int, int]
    spacing: tuple[float, float]
    minimum: tuple[float, float]

    @property
    def maximum(self) -> tuple[float, float]:
        return tuple(m + n * d for m, n, d in zip(self.minimum, self.shape, self.spacing))

    @property
    def cell_area(self) -> float:
        return self.spacing[0] * self.spacing[1]

    def centres(self, spark: SparkSession) -> DataFrame:
        nx, ny = self.shape
        t = spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("i"), F.floor(F.col("id") / nx).cast("int").alias("j"))
        at = lambda c, k: F.lit(self.minimum[k]) + (F.col(c) + 0.5) * F.lit(self.spacing[k])
        return t.select("i", "j", at("i", 0).alias("x"), at("j", 1).alias("y"))


def cell_index(x: Column, grid: Grid, axis: int) -> Column:
    """Index of the cell whose centre this coordinate is; null off the centres."""
    m, d, n = grid.minimum[axis], grid.spacing[axis], grid.shape[axis]
    k = F.bround((x - m) / d - 0.5).cast("int")
    return F.when((k >= 0) & (k < n) & close(x, m + (k + 0.5) * d, d), k)


def validate_table(raw: DataFrame, grid: Grid) -> DataFrame:
    """Text cells (row, x, y, value) -> parsed numbers, cell indices and reason codes of each row.

    A row with a code is not part of the field. Duplicates are all rows of a centre that has several.
    """
    names = ["x", "y", "value"]
    t = raw.withColumns({f"_{c}": F.expr(f"try_cast(trim({c}) AS double)") for c in names})
    blank = [F.coalesce(F.trim(c), F.lit("")) == "" for c in names]
    any_of = lambda cs: cs[0] | cs[1] | cs[2]
    text = any_of([~b & F.col(f"_{c}").isNull() for b, c in zip(blank, names)])
    odd = any_of([F.coalesce(F.isnan(f"_{c}") | (F.abs(f"_{c}") == float("inf")), F.lit(False)) for c in names])
    bad = codes_of((any_of(blank), "MISSING_VALUE"), (text, "NONNUMERIC_VALUE"), (odd, "NONFINITE_VALUE"))
    t = t.withColumn("_bad", bad).withColumns({"i": cell_index(F.col("_x"), grid, 0), "j": cell_index(F.col("_y"), grid, 1)})
    good = t.where(F.size("_bad") == 0).groupBy("_x", "_y").agg(F.count("*").alias("_n")).where("_n > 1")
    t = t.join(good, ["_x", "_y"], "left")
    off = (F.size("_bad") == 0) & (F.col("i").isNull() | F.col("j").isNull())
    codes = F.concat("_bad", codes_of((F.col("_n").isNotNull(), "DUPLICATE_COORDINATE"), (off, "GRID_COORDINATE_MISMATCH")))
    return t.select("row", F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_value").alias("value"), "i", "j", codes.alias("reason_codes"))


def missing_cells(field: DataFrame, grid: Grid) -> DataFrame:
    """Cells (i, j) of the grid without a row."""
    return grid.centres(field.sparkSession).select("i", "j").join(field.select("i", "j"), ["i", "j"], "left_anti")


def normalize(field: DataFrame, permutation: tuple[int, int], scale: tuple[float, float], offset: tuple[float, float]) -> DataFrame:
    """Affine change of coordinates: new axis k is scale[k] * old axis permutation[k] + offset[k]."""
    old = [F.col("x"), F.col("y")]
    return field.withColumns({n: F.lit(float(scale[k])) * old[permutation[k]] + F.lit(float(offset[k])) for k, n in enumerate(("x", "y"))})


def normalize_status(field: DataFrame, permutation: tuple[int, int], scale: tuple[float, float], offset: tuple[float, float], output: Grid) -> DataFrame:
    """One row: whether all that the transform makes of (x, y) lies on the centres of the grid that it declares, on one row each."""
    if sorted(permutation) != [0, 1] or not all(scale):
        raise ValueError("the permutation is (0, 1) or (1, 0), and no scale is zero")
    t = normalize(field, permutation, scale, offset)
    t = t.select(cell_index(F.col("x"), output, 0).alias("i"), cell_index(F.col("y"), output, 1).alias("j"))
    n = t.agg(F.count_if(F.col("i").isNull() | F.col("j").isNull()).alias("off"))
    bad = F.col("off") > 0
    return n.select(F.when(bad, "FAIL").otherwise("PASS").alias("status"), codes_of((bad, "COORDINATE_TRANSFORM_MISMATCH")).alias("reason_codes"))


def shares_domain(a: Grid, b: Grid) -> bool:
    """Whether two grids cover the same rectangle, but for rounding."""
    near = lambda x, y, s: abs(x - y) <= 1e-10 * max(s, abs(x), abs(y), 1.0)
    return all(near(p[k], q[k], max(a.spacing[k], b.spacing[k])) for p, q in ((a.minimum, b.minimum), (a.maximum, b.maximum)) for k in (0, 1))


def regrid_status(field: DataFrame, source: Grid, target: Grid, operator: str, low: float, high: float | None = None) -> DataFrame:
    """One row: coverage, status and codes of a re-gridding of (i, j, value): a whole source grid, one domain, a coverage that meets its criterion."""
    cells = source.shape[0] * source.shape[1]
    n = field.agg(F.count("*").alias("_n"), F.countDistinct("i", "j").alias("_d")).withColumn("_k", F.lit(1))
    area = target.shape[0] * target.shape[1]
    c = regrid(field, source, target).agg((F.coalesce(F.sum("coverage"), F.lit(0.0)) / F.lit(float(area))).alias("coverage")).withColumn("_k", F.lit(1))
    t = n.join(F.broadcast(c), "_k")  # one row each
    whole, share = (F.col("_n") == cells) & (F.col("_d") == cells), F.lit(shares_domain(source, target))
    met = F.coalesce(compare(F.col("coverage"), F.lit(operator), F.lit(low), F.lit(high).cast("double")), F.lit(False))
    codes = codes_of((~whole, "GRID_SHAPE_MISMATCH"), (~whole, "COORDINATE_LOOKUP_FAILED"), (~share, "TARGET_DOMAIN_MISMATCH"), (whole & share & ~met, "COVERAGE_CRITERION_NOT_MET"))
    return t.select(F.when(whole & share, F.col("coverage")).otherwise(0.0).alias("coverage"), F.when(F.size(codes) == 0, "PASS").otherwise("FAIL").alias("status"), codes.alias("reason_codes"))


def _overlaps(spark: SparkSession, source: Grid, target: Grid, axis: int) -> DataFrame:
    """(t, s, w): lengths that target and source cells share on one axis, by index arithmetic."""
    t0, td = F.lit(target.minimum[axis]) + F.col("t") * F.lit(target.spacing[axis]), F.lit(target.spacing[axis])
    s0, sd, n = F.lit(source.minimum[axis]), F.lit(source.spacing[axis]), source.shape[axis]
    lo = F.greatest(F.floor((t0 - s0) / sd).cast("int"), F.lit(0))
    hi = F.least(F.ceil((t0 + td - s0) / sd).cast("int") - 1, F.lit(n - 1))
    one = spark.range(target.shape[axis]).select(F.col("id").cast("int").alias("t"))
    one = one.withColumns({"a": t0, "lo": lo, "hi": hi}).where("lo <= hi").withColumn("s", F.explode(F.sequence("lo", "hi")))
    start = s0 + F.col("s") * sd
    w = F.least(F.col("a") + td, start + sd) - F.greatest(F.col("a"), start)
    return one.select("t", "s", w.alias("w")).where(F.col("w") > 1e-12 * td)


def regrid(field: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """Conservative re-gridding of (i, j, value): mean over each target cell of what covers it, and the covered share.

    Rectangles separate by axis, so two one-dimensional overlap tables and equi-joins replace the band join.
    """
    spark = field.sparkSession
    wx = _overlaps(spark, source, target, 0).select(F.col("t").alias("ti"), F.col("s").alias("i"), F.col("w").alias("wx"))
    wy = _overlaps(spark, source, target, 1).select(F.col("t").alias("tj"), F.col("s").alias("j"), F.col("w").alias("wy"))
    met = field.select("i", "j", "value").join(wx, "i").join(wy, "j")
    area = F.col("wx") * F.col("wy")
    out = met.groupBy("ti", "tj").agg((F.sum(F.col("value") * area) / F.lit(target.cell_area)).alias("value"), (F.sum(area) / F.lit(target.cell_area)).alias("coverage"))
    return out.select(F.col("ti").alias("i"), F.col("tj").alias("j"), "value", "coverage")


def integral(field: DataFrame, grid: Grid) -> DataFrame:
    return field.agg((F.sum("value") * F.lit(grid.cell_area)).alias("integral"))


def integral_check(source: DataFrame, source_grid: Grid, target: DataFrame, target_grid: Grid, tolerance: float) -> DataFrame:
    """One row: both integrals, relative error, status and codes."""
    a = integral(source, source_grid).select(F.col("integral").alias("source_integral"))
    b = integral(target, target_grid).select(F.col("integral").alias("target_integral"))
    t = a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")
    s, e = F.col("source_integral"), F.abs(F.col("target_integral") - F.col("source_integral"))
    t = t.withColumn("relative_error", F.when(s == 0, F.when(F.col("target_integral") == 0, 0.0)).otherwise(e / F.nullif(F.abs(s), F.lit(0.0))))
    ok = F.col("relative_error") <= tolerance
    status = F.when(F.col("relative_error").isNull(), "PARTIAL").when(ok, "PASS").otherwise("FAIL")
    codes = codes_of((F.col("relative_error").isNull(), "ZERO_REFERENCE_INTEGRAL"), (F.col("relative_error").isNotNull() & ~F.coalesce(ok, F.lit(False)), "INTEGRAL_CRITERION_NOT_MET"))
    return t.select("*", status.alias("status"), codes.alias("reason_codes"))
