"""The trusted target is every document labelled good."""

from pyspark.sql import functions as F

from ledgerlake.llm import quality


def test_every_good_label_counts(spark):
    docs = spark.range(20_050).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"))
    out = quality.quality(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    # Target and corpus are the same documents, so no n-gram tells them apart.
    assert out.where("abs(score) > 1e-8").count() == 0
