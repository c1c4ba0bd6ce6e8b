"""Mixing sources to target weights by hash-threshold histograms.

Words are summed by source and bucket of a row's hash. Where a source's budget ends inside a bucket, only
that bucket is summed again by the next bits of the hash, until it holds a single row (or equal rows). The
budget then is one threshold per source: rows whose hash lies at or below it are taken once more than the
others. Thresholds nest: the rows of a smaller budget are among those of a larger one. No row is ever sorted.

Defined cases: a null text has size 0; the null source is a source of its own and comes last; equal rows
share a hash and are taken alike; sources without words have target 0; null ids are ids like any other;
columns of any name stay as they are in the mixed documents; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import filled, n_words, running, scratch

BITS, LEVELS, SALTS = 8, 8, 16
LOWEST = -(1 << 63)


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("v"), source), F.lit("n"))


def hash_key(id_col: str, text_col: str, seed: int) -> Column:
    """A row's place in the order of hashes, as a signed number of 64 bits."""
    return F.xxhash64(F.lit(seed), F.col(id_col), filled(F.col(text_col)))


def _bucket(level: int) -> Column:
    up = F.col("key").bitwiseXOR(F.lit(LOWEST))
    return F.shiftrightunsigned(up, 64 - BITS * (level + 1))


def fill_targets(sources: DataFrame, total: float, share: float, cap: float) -> DataFrame:
    """Adds target = min(cap * source_size, level * weight), at the level where the targets add up to share * total.

    A source is full from the level cap * source_size / weight on. In the order of those levels, what the targets add up to at each of them
    comes from two running sums, so the stretch that holds the level is found without a loop; if all sources are full
    before, there is no level and the targets are the caps.
    """
    capped = F.col("source_size") * F.lit(float(cap))
    known = sources.withColumns({"capped": capped, "full_at": capped / F.col("weight")})
    sums = running(known, [F.col("full_at"), F.col("skey")], {"full": F.col("capped"), "heavy": F.col("weight")})
    weights = known.agg(F.sum("weight")).first()[0] or 0.0
    reached = F.col("full") + (F.lit(weights) - F.col("heavy")) * F.col("full_at")
    edge = sums.where(reached >= F.lit(total * share)).agg(F.min(F.struct("full_at", "skey", "full", "heavy"))).first()[0]
    if edge is None:
        return sources.withColumn("target", capped)
    level = max((total * share - edge["full"]) / (weights - edge["heavy"]), 0.0)
    return sources.withColumn("target", F.least(capped, F.col("weight") * F.lit(level)))


def mix_plan(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sized: (source, skey, size, key). One row per source: source_size, target, copies that every row gets, and
    the last hash that gets one more (null: none does)."""
    spark = sized.sparkSession
    sums = sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    ranked = running(sums, [F.col("source").isNull(), F.col("source")], {"rank": F.lit(1)})
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = scratch(ranked.withColumn("weight", w))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    planned = fill_targets(ranked, float(total), share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    planned = scratch(planned.withColumn("copies", whole).withColumn("need", F.col("target") - F.col("copies") * F.col("source_size")))

    found = None
    bounds = planned.where("need > 0").select("skey", F.lit(0).cast("long").alias("prefix"), "need")
    for level in range(LEVELS):
        rows = sized.where("size > 0")
        if level:
            rows = rows.withColumn("prefix", _bucket(level - 1)).join(bounds.select("skey", "prefix"), ["skey", "prefix"], "left_semi")
        sums = rows.groupBy("skey", _bucket(level).alias("bucket")).agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("key").alias("first"), F.max("key").alias("last"))
        # At most 2**BITS sums a source meet here, whatever the number of rows.
        upto = F.sum("w").over(Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        edge = sums.withColumn("upto", upto).join(bounds.select("skey", F.col("need").alias("want")), "skey").where("upto > want and upto - w <= want")
        edge = scratch(edge.select("skey", F.col("bucket").alias("prefix"), (F.col("want") - (F.col("upto") - F.col("w"))).alias("need"), "w", "n", "first", "last"))
        done = edge.where((F.col("n") == 1) | (F.col("first") == F.col("last")) | F.lit(level == LEVELS - 1))
        # The rows below the boundary are in; those at it are too if that comes nearer to the target.
        over = F.when(F.col("need") * 2 > F.col("w"), F.col("last")).when(F.col("first") > LOWEST, F.col("first") - 1)
        done = done.select("skey", over.alias("upto_key"))
        found = done if found is None else found.unionByName(done)
        bounds = edge.where((F.col("n") > 1) & (F.col("first") != F.col("last")))
        if level == LEVELS - 1 or bounds.isEmpty():
            break
    out = planned.join(found, "skey", "left").select("skey", "source", "source_size", "target", "copies", "upto_key")
    return scratch(out)


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows: with skey and key. Adds source_size, target and copies (how often the mix takes the row).

    Plans of many sources are spread over SALTS rows a source, so that the join deals a hot source out.
    """
    salted = plan.drop("source").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.withColumn("_salt", F.pmod(F.col("key"), F.lit(SALTS)).cast("int")).join(salted, ["skey", "_salt"])
    more = F.when(F.col("key") <= F.col("upto_key"), 1).otherwise(0)
    return out.withColumn("copies", F.col("copies") + more).drop("_salt", "upto_key")


def sized_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), hash_key(id_col, text_col, seed).alias("key"))
    return scratch(rows.withColumn("skey", source_key(F.col("source"))))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken = copies * size."""
    sized = sized_rows(docs, id_col, text_col, source_col, seed)
    out = with_copies(sized, mix_plan(sized, weights, share, cap))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """The mixed documents themselves, with their own columns; a document taken twice is there twice."""
    plan = mix_plan(sized_rows(docs, id_col, text_col, source_col, seed), weights, share, cap)
    rows = docs.select(F.struct("*").alias("_row"), source_key(F.col(source_col)).alias("skey"), hash_key(id_col, text_col, seed).alias("key"))
    taken = with_copies(rows, plan).where("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("_row.*")
