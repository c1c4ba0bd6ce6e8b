"""Event streams: windowed counts with late data, sessions, once-only events, activity as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of (event_id, ts, user_id, event_type, value, props) as a stream; ts gets a time zone, which watermarks need."""
    # As a pattern, for a path may be a single file, which a file stream takes for a folder.
    raw = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").parquet(f"{path[:-1]}[{path[-1]}]")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "value")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def _track(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    n, last = state.get if state.exists else (0, None)
    for pdf in batches:
        n += len(pdf)
        newest = pdf["ts"].max()
        last = newest if last is None or newest > last else last
    state.update((n, last))
    yield pd.DataFrame({"user_id": [key[0]], "events": [n], "last_seen": [last]})


def activity_state(events: DataFrame) -> DataFrame:
    """Events and last sight of each user, kept as state."""
    return events.groupBy("user_id").applyInPandasWithState(_track, "user_id long, events long, last_seen timestamp", "n long, last timestamp", "update", "NoTimeout")
