"""Quality rules: base counts of a text and a hashed n-gram log-likelihood ratio. DataFrame functions only.

Every word and word pair falls into one of BUCKETS buckets. One multinomial over buckets is counted from the trusted
target (every document labelled good), the other from every document. A
document's score is the mean over its n-grams of log(p_target / p_raw), both smoothed by one count a bucket. The
threshold is found on the scores of the labelled documents that pass the base rules, in steps of STEP: the cut with the least of good_weight times the
share of good documents lost plus the share of bad documents kept, the lowest at ties. It is then applied to every document.

Defined cases: a null text has no words and fails the base rules; texts without n-grams score 0; without labels of
both kinds, or without a target, nothing is rejected by score; repeated ids in the labels count once, by their highest label; a document
without an id is judged, but has no label; equal rows get equal verdicts; no columns but id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filled, scratch, sieve

BUCKETS, STEP, CLIP = 8192, 0.005, 20.0
SYMBOLS = r"[#*$%&|<>]"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK_RUN), lambda w: w != "")


def base_counts(docs: DataFrame, text_col: str = "_text") -> DataFrame:
    """Adds _words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.col(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    out = docs.withColumn("_words", words_of(text)).withColumn("_lines", lines)
    out = out.withColumn("n_words", F.size("_words").cast("long")).withColumn("_m", F.greatest(F.size("_words") - 2, F.lit(0)))
    out = out.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    out = out.withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    triple = F.transform(F.slice("_words", F.lit(1), F.col("_m")), lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    out = out.withColumn("_tri", triple).withColumn("_some", F.size(F.array_distinct("_tri")) < F.col("_m"))
    # Windows found twice: hashes sorted with their positions in the low bits, then neighbours compared in full.
    out = out.withColumn("_bits", F.ceil(F.log2(F.col("_m") + F.lit(2))).cast("int"))
    packed = F.transform("_tri", lambda h, i: F.call_function("shiftleft", h, F.col("_bits")).bitwiseOR(i.cast("long")))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1
    out = out.withColumn("_at", F.when(F.col("_some"), F.transform(F.sort_array(packed), lambda x: x.bitwiseAND(mask))))
    out = out.withColumn("_full", F.when(F.col("_some"), F.transform("_at", lambda p: F.get("_tri", p.cast("int")))))
    near = lambda p, j: F.coalesce(F.get("_full", j) == F.get("_full", j - 1), F.lit(False)) | F.coalesce(F.get("_full", j) == F.get("_full", j + 1), F.lit(False))
    out = out.withColumn("_found", F.when(F.col("_some"), F.sort_array(F.filter("_at", near))))
    gaps = F.zip_with("_found", F.slice("_found", F.lit(2), F.size("_tri") + 1), lambda p, q: F.when(p.isNull(), 0).otherwise(F.least(F.lit(3), F.coalesce(q - p, F.lit(3)))))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.withColumn("n_repeat_words", F.when(F.col("_some"), covered).otherwise(F.lit(0).cast("long"))).drop("_m", "_tri", "_some", "_bits", "_at", "_full", "_found")


def fails_base(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def _pair(words: str, i: Column) -> Column:
    return F.pmod(F.xxhash64(F.get(words, i - 1), F.get(words, i)), F.lit(BUCKETS)).cast("int")


def _single(words: str, i: Column) -> Column:
    return F.pmod(F.xxhash64(F.get(words, i)), F.lit(BUCKETS)).cast("int")


def _places(words: str, first: int) -> Column:
    """Indices of the words from first on; none where there are none."""
    return F.when(F.size(words) > first, F.sequence(F.lit(first), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))


def bucket_weights(docs: DataFrame, labels: DataFrame) -> list[float]:
    """log(p_target / p_raw) by bucket; zeros without a target."""
    good = labels.where("quality = 1").select("_id", F.lit(1).alias("_good"))
    # Only texts that may be of the target meet its ids: the others stay where they are. They meet in a sort-merge join at every size, as labels may be many.
    may, other = sieve(docs.select("_id", "_text"), F.xxhash64("_id"), good.select(F.xxhash64("_id").alias("k")))
    rows = may.join(good.hint("merge"), "_id", "left").unionByName(other.withColumn("_good", F.lit(0)))
    rows = rows.select(words_of(F.col("_text")).alias("_w"), F.coalesce("_good", F.lit(0)).alias("_good"))
    grams = F.concat(F.transform(_places("_w", 0), lambda i: _single("_w", i)), F.transform(_places("_w", 1), lambda i: _pair("_w", i)))
    counts = rows.select("_good", F.explode(grams).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("_good").alias("target")).collect()
    raw, target = [1] * BUCKETS, [1] * BUCKETS
    for r in counts:  # at most BUCKETS rows
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if sum(target) == BUCKETS:
        return [0.0] * BUCKETS
    a, b = math.log(sum(target)), math.log(sum(raw))
    return [round(math.log(t) - a - math.log(r) + b, 9) for t, r in zip(target, raw)]


def best_cut(scored: DataFrame, labels: DataFrame, good_weight: float) -> float:
    """The score below which documents are rejected."""
    step = F.floor(F.greatest(F.least(F.col("score"), F.lit(CLIP)), F.lit(-CLIP)) / F.lit(STEP)).cast("int")
    sums = scored.join(labels, "_id").groupBy(step.alias("step"), "quality").agg(F.count("*").alias("n")).collect()  # at most 2 * CLIP / STEP steps
    bins: dict[int, list[int]] = {}
    for r in sums:
        if r["quality"] in (0, 1):
            bins.setdefault(r["step"], [0, 0])[r["quality"]] += r["n"]
    bad, good = (sum(v[i] for v in bins.values()) for i in (0, 1))
    if not bad or not good:
        return -math.inf
    best, cut, lost, kept = 1.0, -math.inf, 0, bad
    for s in sorted(bins):
        kept -= bins[s][0]
        lost += bins[s][1]
        if (cost := good_weight * lost / good + kept / bad) < best:
            best, cut = cost, round((s + 1) * STEP, 6)
    return cut


def quality(docs: DataFrame, labels: DataFrame, good_weight: float = 4.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score, threshold, text_key.

    labels: (id_col, quality), 1 for the trusted target.
    """
    rows = docs.select(F.col(id_col).alias("_id"), filled(F.col(text_col)).alias("_text"))
    labels = labels.groupBy(F.col(id_col).alias("_id")).agg(F.max("quality").alias("quality")).where("_id is not null and quality is not null")
    weights = bucket_weights(rows, labels)
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    counted = base_counts(rows)
    total = F.aggregate(_places("_words", 0), F.lit(0.0), lambda a, i: a + F.get(table, _single("_words", i)) + F.when(i > 0, F.get(table, _pair("_words", i))).otherwise(F.lit(0.0)))
    score = F.when(F.size("_words") > 0, total / (2 * F.size("_words") - 1)).otherwise(F.lit(0.0))
    scored = scratch(counted.select("_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", score.alias("score"), F.xxhash64("_text").alias("text_key")))
    failed = fails_base(F.col("n_words"), F.col("n_repeat_words"))
    cut = best_cut(scored.where(~failed), labels, good_weight)
    return scored.select(
        F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("score") >= F.lit(cut))).alias("kept"), "score", F.lit(cut).alias("threshold"), "text_key",
    )
