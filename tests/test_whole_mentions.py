"""Mentions and native assets of every document."""

from pyspark.sql import functions as F

from ledgerlake import plans

SF = "/root/testdata/sf0.001"


def test_tool_mentions_cover_every_document(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["tool"]: r for r in plans.queries()["tool_mentions_ranked"](spark, SF).collect()}
    assert sum(r["native"] for r in rows.values()) == d.count()
    want = d.agg(F.sum(F.regexp_count(F.lower("text"), F.lit(r"\bthe\b")))).first()[0]
    assert sum(rows["the"][k] for k in ("primary", "supporting", "reference")) == want
