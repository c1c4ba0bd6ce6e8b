"""A training-corpus pipeline over `documents`: five stages, each one operator at work on all that the one before kept.

Defined cases: null and empty texts have no words and fail the quality rules; null ids stay, and come last where one of several documents is
chosen; of equal rows one stays; documents whose text is changed get a new n_chars; other columns, whatever their names, stay as they are up to
packing, which returns columns of its own; an empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import jaccard, lines, mixing, packing, quality
from ledgerlake.llm.common import WORD, filled, scratch, sieve


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    judged = quality.quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    gone = scratch(judged.where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(filled(F.col("text"))).alias("key"))
    may, stay = sieve(rows, F.xxhash64("id", "key"), gone.select(F.xxhash64("gone_id", "gone_key").alias("k")))
    may = may.join(gone.hint("merge"), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left_anti")
    return stay.unionByName(may).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more go; so do documents that have no word left."""
    out = lines.delete_runs(docs, min_words=50)
    changed = F.col("n_removed") > 0
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("row.n_chars")))
    return out.where(~changed | F.regexp_like("text", F.lit(WORD))).select(row.alias("row")).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return jaccard.one_per_component(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken twice is there twice."""
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of like-sized pieces: doc_id, piece, first_word, n_words, bucket_len, batch_id, slot."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: Hashes and iterated searches decide what stays, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
