"""What the operators of this subpackage share: word expressions, tables in the shared folder, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of anything but these ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def filled(text: Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(text, F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(filled(text), F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a local master may go without: it then gets a temporary folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, outlives executors.

    It stays as long as the session's JVM, so that any result may read it at any time, unless its maker discards it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ledgerlake/{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that scratch() made and that no later result reads: each operator names its own, and no others."""
    for t in tables:
        fs, where = _file_system(t.sparkSession, t._scratch_path)
        fs.delete(where, True)


def sieve(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that may be among the keys (k, 64 bits), and rows that are not, by a bitmap of the keys' upper bits.

    The bitmap has 16 bits a key and 2**25 at most, in a table of at most 2**19 words, which is broadcast. With more keys it lets more through, in the end
    all; so a join that follows is exact at any size, and moves few rows as long as the keys are few.
    """
    keys = scratch(keys.select("k").distinct())
    bits = min(max((keys.count() * 16).bit_length(), 12), 25)
    place = lambda c: F.shiftrightunsigned(c, 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place(F.col("k")) % 64).cast("int"))
    words = scratch(keys.groupBy(F.shiftright(place(F.col("k")), 6).alias("_word")).agg(F.bit_or(bit).alias("_bits")))
    discard(keys)
    at = rows.withColumn("_place", place(key)).withColumn("_word", F.shiftright("_place", 6)).join(F.broadcast(words), "_word", "left")
    hit = F.coalesce(F.call_function("shiftrightunsigned", "_bits", (F.col("_place") % 64).cast("int")).bitwiseAND(1) == 1, F.lit(False))
    return at.where(hit).select(*rows.columns), at.where(~hit).select(*rows.columns)


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Lets texts go to Python in Arrow batches of at most so many bytes (or one text), whatever the session allows: memory then follows the batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) != f"{most}b":
        spark.conf.set(key, f"{most}b")


def tidy(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished jobs now, instead of whenever the driver's garbage is collected."""
    spark.sparkContext._jvm.System.gc()


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds the sums over all rows before each row in a total order, without one task that sorts everything.

    Rows are range partitioned and summed inside each partition; only the partitions' totals,
    as many as there are partitions, come to the driver.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    window = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = df.withColumns({f"_{k}": c for k, c in sums.items()}).repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id())
    inside = scratch(dealt.withColumns({k: F.coalesce(F.sum(f"_{k}").over(window), F.lit(0)) for k in sums}))
    totals = {r["_pid"]: r for r in inside.groupBy("_pid").agg(*[F.sum(f"_{k}").alias(k) for k in sums]).collect()}
    before, rows = dict.fromkeys(sums, 0), []
    for pid in sorted(totals):
        rows.append((pid, *before.values()))
        before = {k: before[k] + (totals[pid][k] or 0) for k in sums}
    kinds = dict(inside.dtypes)
    rows = [(pid, *(float(v) if kinds[k] == "double" else v for k, v in zip(sums, held))) for pid, *held in rows]
    at = spark.createDataFrame(rows, "_pid int, " + ", ".join(f"_before_{k} {kinds[k]}" for k in sums))
    return inside.join(F.broadcast(at), "_pid").withColumns({k: F.col(k) + F.col(f"_before_{k}") for k in sums}).drop("_pid", *[f"_{k}" for k in sums], *[f"_before_{k}" for k in sums])


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down (a to b), or only edges from above; distinct edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("b").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("e")).select("e.*")
    held = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not held.agg(F.max((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0)))).first()[0]


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Connected components of an edge table (a, b): one row (node, component) per node that has an edge.

    The component is the smallest node in it. Large-star and small-star steps alternate until all that is
    left are stars; each step is a grouped minimum, combined before the shuffle, and an equi-join, so a
    node with very many edges never has to be gathered in one place. Edges with a null end and loops are ignored.
    """
    a, b = "a", "b"
    now = scratch(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .distinct()
    )
    for _ in range(limit):
        if _all_stars(now):
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # The same with what lies below each node: every edge already goes from the larger node to the smaller.
        down = scratch(large)
        discard(now)
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = scratch(small)
        discard(down)
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
