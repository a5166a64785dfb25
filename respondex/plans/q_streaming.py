"""Query: the review stream, run over the events table to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from respondex.plans.q_sources import fresh
from respondex.plans.registry import query, table
from respondex.streaming.reviews import current, keep_latest


@query("w3_latest_review_stream", "SELECT user_id AS feature, max_by(event_type, (ts, event_id)) AS status, max_by(event_id, (ts, event_id)) AS edit_id FROM events GROUP BY 1")
def w3_stream(spark, d):
    path = fresh(spark, "review-stream")
    kind = table(spark, d, "events").schema
    e = spark.readStream.schema(kind).parquet(f"{d}/events.parquet*")
    r = e.select(F.col("user_id").alias("feature"), F.col("event_id").alias("edit_id"), F.col("ts").alias("edited_at"), F.col("event_type").alias("status"))
    keep_latest(r, ["feature"], path).awaitTermination()
    return current(spark, path).select("feature", "status", "edit_id")
