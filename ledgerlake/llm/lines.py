"""Line deduplication by prefix doubling over line ids. DataFrame functions only.

A text is a sequence of line ids (hashes of its lines with a word). Prefix doubling names the first 1, 2, 4, ... ids of every
suffix: a name at twice the depth is the pair of two names at a depth. With hashes for ranks, the pairs need no sorting between
rounds, so a document doubles its own suffixes in place, and suffixes of all documents that share a name at some
depth are an interval of the suffix array with that longest common prefix. A run of at least `min_words` words is the union of
the windows in it that are the shortest of so many words from their first, or to their last, line; so intervals are looked up
at the depths of those windows alone, each the overlap of two names of a power of two. Every window whose interval has an
earlier suffix (by id, then line) is a later copy, and its lines are deleted; runs so found are maximal.

A line with a word stands for at least one word, so windows have at most min_words lines and doubling ends after
log2(min_words) rounds. Blank lines count as no line; those between deleted lines of one window go too.

Defined cases: null texts stay null with no lines deleted (n_lines 1, the empty line); equal rows are one place, and
stay alike; null ids come first; of equal runs in one text the first stays; input columns called n_lines or n_removed
give way to the operator's, any others stay as they are; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, discard, filled, scratch, sieve


def _doubled(x: str, step: int, join) -> Column:
    return F.transform(x, lambda v, i: join(v, F.get(x, i + step)))


def _further(k: int, min_words: int):
    """One step of 2**k lines on, where the words stay below min_words."""

    def step(x: Column, i: Column) -> Column:
        n = x["n"] + F.coalesce(F.get(f"_w{k}", i + x["c"]), F.lit(0))
        return F.when(n < min_words, F.struct((x["c"] + (1 << k)).alias("c"), n.alias("n"))).otherwise(x)

    return step


def windows(rows: DataFrame, min_words: int) -> DataFrame:
    """rows: (id, k1, k2, text). (id, k1, k2, s, e, a, b): first and last line of each window, and its name in 128 bits."""
    keys = ["id", "k1", "k2"]
    line = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("no"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(7), x).alias("g"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    t = rows.select(*keys, F.filter(line, lambda x: x["n"] > 0).alias("_l"))
    t = t.where(F.aggregate("_l", F.lit(0), lambda a, x: a + x["n"]) >= min_words)
    t = t.select(*keys, F.col("_l.no").alias("_no"), F.col("_l.h").alias("_h0"), F.col("_l.g").alias("_g0"), F.col("_l.n").alias("_w0"))
    levels = max(1, (min_words - 1).bit_length())
    for k in range(levels):
        step = 1 << k
        t = t.withColumns({
            f"_h{k + 1}": _doubled(f"_h{k}", step, lambda v, o: F.xxhash64(v, o)),
            f"_g{k + 1}": _doubled(f"_g{k}", step, lambda v, o: F.xxhash64(v, o)),
            f"_w{k + 1}": _doubled(f"_w{k}", step, lambda v, o: v + F.coalesce(o, F.lit(0))),
        })
    # Down the levels again: how many lines can follow each line before the words reach min_words.
    t = t.withColumn("_at", F.transform("_w0", lambda v: F.struct(F.lit(0).alias("c"), F.lit(0).alias("n"))))
    for k in range(levels, -1, -1):
        t = t.withColumn("_at", F.transform("_at", _further(k, min_words)))
    size = F.size("_no")
    last = F.transform("_at", lambda x, i: F.least(i + x["c"], size))
    t = t.withColumn("_f", last)  # last line of the shortest window from each line; size if none is

    def named(x: str, s: Column, n: Column) -> Column:
        out = F.xxhash64(n, F.get(f"{x}0", s))
        for k in range(1, levels + 1):
            out = F.when(n >= (1 << k), F.xxhash64(n, F.get(f"{x}{k}", s), F.get(f"{x}{k}", s + n - (1 << k)))).otherwise(out)
        return out

    def window(s: Column, e: Column) -> Column:
        return F.struct(F.get("_no", s).alias("s"), F.get("_no", e).alias("e"), named("_h", s, e - s + 1).alias("a"), named("_g", s, e - s + 1).alias("b"))

    # From each line: its shortest window, and those that end before the next line's does, the shortest to their last lines.
    each = F.transform("_f", lambda f, s: F.when(f < size, F.transform(F.sequence(f, F.greatest(f, F.coalesce(F.get("_f", s + 1), size) - 1)), lambda e: window(s, e))).otherwise(F.array().cast("array<struct<s:int,e:int,a:bigint,b:bigint>>")))
    return t.select(*keys, F.explode(F.flatten(each)).alias("w")).select(*keys, "w.*")


def later_copies(found: DataFrame) -> DataFrame:
    """The windows (k1, k2, s, e) that an earlier one equals."""
    place = F.struct("id", "k1", "k2", "s")
    firsts = found.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("a", "b", "first")
    return found.join(firsts, ["a", "b"]).where(place > F.col("first")).select("k1", "k2", "s", "e").distinct()


def delete_runs(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, text, n_lines, n_removed): each document as it was, and its text with later copies of line runs deleted."""
    carried = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("old"), filled(F.col(text_col)).alias("text"))
    keyed = carried.select("row", "id", "old", "text", F.xxhash64("id", "text").alias("k1"), F.xxhash64("text", "id").alias("k2"))
    found = scratch(windows(keyed.select("id", "k1", "k2", "text"), min_words))
    gone = scratch(later_copies(found).groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("gone")))
    discard(found)
    # Only texts that may lose lines meet what they lose: the others stay where they are. They meet in a sort-merge join at every size.
    may, other = sieve(keyed, F.col("k1"), gone.select(F.col("k1").alias("k")))
    met = may.join(gone.hint("merge"), ["k1", "k2"], "left").select("row", "old", "text", "gone")
    hit = F.col("gone").isNotNull()
    lines = F.split("text", "\n")
    out = met.unionByName(other.select("row", "old", "text", F.lit(None).cast(dict(gone.dtypes)["gone"]).alias("gone")))
    out = out.withColumn("lines", F.when(hit, lines)).withColumn("n_lines", F.size(lines).cast("long"))
    dead = F.flatten(F.transform("gone", lambda d: F.sequence(d["s"], d["e"])))
    out = out.withColumn("stay", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), dead))
    left = F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n")
    removed = F.when(hit, F.col("n_lines") - F.size("stay")).otherwise(F.lit(0)).cast("long")
    return out.select("row", F.when(hit, left).otherwise(F.col("old")).alias("text"), "n_lines", removed.alias("n_removed"))


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their own columns, later copies of line runs deleted from the text, and n_lines, n_removed (instead of columns of these names)."""
    out = delete_runs(docs, min_words, id_col, text_col)
    own = [(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*own, "n_lines", "n_removed")
