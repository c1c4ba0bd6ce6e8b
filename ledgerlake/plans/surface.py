"""The engine's general surface: what Spark adds to the operators proper."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.functions.text import dotted

from .registry import query, table


@query("""SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def json_path_get(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.where("k is not null")


@query("""SELECT event_id, json_exists(p, '$.a.k') AS found, json_extract_string(p, '$.a.k') AS value FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"a": {"k": null}}' WHEN 1 THEN '{"a": {"j": 1}}' WHEN 2 THEN concat('{"a": ', props, '}') ELSE '{"a": 7}' END AS p FROM events)""")
def json_path_found(spark, sf):
    """A dotted path that isn't there told from one that leads to null."""
    k = F.col("event_id") % 4
    p = F.when(k == 0, '{"a": {"k": null}}').when(k == 1, '{"a": {"j": 1}}').when(k == 2, F.concat(F.lit('{"a": '), "props", F.lit("}"))).otherwise('{"a": 7}')
    return table(spark, sf, "events").select("event_id", dotted(p, "a.k").alias("d")).select("event_id", "d.found", "d.value")


@query("""SELECT event_type, user_id % 5 AS part, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 5)""")
def cube_by_status(spark, sf):
    return table(spark, sf, "events").withColumn("part", F.col("user_id") % 5).cube("event_type", "part").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CAST(sum(event_id) OVER w AS BIGINT) AS running, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def window_frames(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events")
    return e.select("event_id", F.sum("event_id").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"), F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("moving"), F.lag("event_type").over(w).alias("before"))


@query("""SELECT user_id % 20 AS project, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1""")
def pivot_types(spark, sf):
    e = table(spark, sf, "events").withColumn("project", F.col("user_id") % 20)
    return e.groupBy("project").pivot("event_type", ["click", "error", "view"]).agg(F.count(F.lit(1))).na.fill(0)


@query()
def approx_distinct(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", 0.5).alias("median"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def hourly_windows(spark, sf):
    e = table(spark, sf, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, CAST(date_trunc('day', ts) + INTERVAL 1 DAY AS TIMESTAMP) AS "end", event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL""")
def stream_windowed_counts(spark, sf):
    """The event table as a finite stream: windowed counts with a watermark, as they stand at its end."""
    import uuid

    from ledgerlake.streaming import events

    name = "s" + uuid.uuid4().hex
    stream = events.windowed_counts(events.read_events(spark, f"{sf}/events.parquet"), size="1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.table(name)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", F.round("value", 4).alias("value"))
