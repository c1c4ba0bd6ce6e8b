"""Packing by optimal length buckets.

The histogram of lengths over the whole table, at most max_len entries, goes to the driver, where dynamic
programming chooses the bucket bounds of least padding. Inside a bucket, batches of budget // bound rows
follow the order of shards: rows are numbered inside a shard, and the shards' counts give each shard its offset. Shards grow in
number with the table, not in size, and only their counts meet, one row a shard. No bucket, however full, is sorted or gathered in one task.

Texts longer than max_len words are cut into pieces of max_len words and a rest; every word is in one piece.

Defined cases: a null or blank text has one piece of 0 words, which lies in the first bucket; equal rows are packed
each, and tie in no order that anything rests on; a null id is carried like any other, and so are columns' names, as none but id and text
is read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import filled, n_words, scratch

#: Shards of a table at least, and rows that a shard has on average where that makes more.
SHARDS, A_SHARD = 1024, 50_000


def optimal_bounds(counts: dict[int, int], buckets: int) -> list[int]:
    """Bounds, ascending, of at most that many buckets, least in total padding: the sum over rows of bound - length.

    Lengths, sorted: bound j closes a bucket of the lengths after bound i. Its padding is
    b_j * (N_j - N_i) - (S_j - S_i), a line in b_j of slope -N_i for each i; the lower hull of these
    lines gives every best i in one pass a layer.
    """
    lengths = sorted(counts)
    if not lengths:
        return []
    n = np.cumsum([0] + [counts[x] for x in lengths]).tolist()
    s = np.cumsum([0] + [counts[x] * x for x in lengths]).tolist()
    size = len(lengths)
    cost = [0] + [None] * size
    back: list[list[int]] = []
    best, best_k = None, 0
    for k in range(1, min(buckets, size) + 1):
        now: list = [None] * (size + 1)
        came = [0] * (size + 1)
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i; slopes fall
        head = 0
        for j in range(1, size + 1):
            i = j - 1
            if cost[i] is not None:
                m, c = -n[i], cost[i] + s[i]
                if hull and hull[-1][0] == m:
                    if hull[-1][1] <= c:
                        m = None
                    else:
                        hull.pop()
                if m is not None:
                    while len(hull) - head >= 2 and (hull[-1][1] - hull[-2][1]) * (hull[-1][0] - m) >= (c - hull[-1][1]) * (hull[-2][0] - hull[-1][0]):
                        hull.pop()
                    hull.append((m, c, i))
            if head >= len(hull):
                head = max(0, len(hull) - 1)
            if not hull:
                continue
            x = lengths[j - 1]
            while head + 1 < len(hull) and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            now[j] = hull[head][0] * x + hull[head][1] + x * n[j] - s[j]
            came[j] = hull[head][2]
        back.append(came)
        cost = now
        if best is None or (now[size] is not None and now[size] < best):
            best, best_k = now[size], k
    bounds, j = [], size
    for k in range(best_k, 0, -1):
        bounds.append(lengths[j - 1])
        j = back[k - 1][j]
    return bounds[::-1]


def pack(docs: DataFrame, max_len: int = 8192, buckets: int = 16, budget: int = 65536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece (from 0), first_word (from 0), n_words, bucket_len, batch_id, slot.

    A batch holds pieces of one bucket, at most budget // bucket_len of them, so that its padded size stays within
    the budget; all batches of a bucket but its last are full.
    """
    if budget < max_len:
        raise ValueError("a batch must hold at least one piece of max_len words")
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).alias("doc_id"), n_words(F.col(text_col)).alias("_n"), F.xxhash64(F.col(id_col), filled(F.col(text_col))).alias("_h"))
    last = F.greatest(F.ceil(F.col("_n") / F.lit(max_len)) - 1, F.lit(0)).cast("int")
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    pieces = scratch(pieces.select("doc_id", "_h", "piece", (F.col("piece").cast("long") * max_len).alias("first_word"), F.least(F.col("_n") - F.col("piece").cast("long") * max_len, F.lit(max_len)).cast("int").alias("n_words")))

    counts = {r["n_words"]: r["n"] for r in pieces.groupBy("n_words").agg(F.count("*").alias("n")).collect()}
    bounds = optimal_bounds(counts, buckets)
    if not bounds:
        return pieces.select("doc_id", "piece", "first_word", "n_words", F.lit(0).alias("bucket_len"), F.lit(0).cast("long").alias("batch_id"), F.lit(0).cast("long").alias("slot"))
    bucket = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_words") <= bounds[i], i).otherwise(bucket)
    shards = max(SHARDS, sum(counts.values()) // A_SHARD)
    dealt = pieces.withColumn("_bucket", bucket).withColumn("_shard", F.pmod(F.xxhash64("_h", "piece"), F.lit(shards)).cast("int"))
    sizes = dealt.groupBy("_bucket", "_shard").agg(F.count("*").alias("_size"))
    before = Window.partitionBy("_bucket").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    place = F.row_number().over(Window.partitionBy("_bucket", "_shard").orderBy("_h", "doc_id", "piece"))
    placed = dealt.withColumn("_place", place).join(offsets, ["_bucket", "_shard"])
    length = F.element_at(F.array(*[F.lit(b) for b in bounds]), F.col("_bucket") + 1)
    room = F.floor(F.lit(budget) / F.greatest(length, F.lit(1)))
    at = F.col("_offset") + F.col("_place") - 1
    return placed.select(
        "doc_id", "piece", "first_word", "n_words", length.alias("bucket_len"),
        (F.col("_bucket").cast("long") * (1 << 48) + F.floor(at / room)).alias("batch_id"), (at % room).alias("slot"),
    )
