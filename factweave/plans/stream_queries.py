"""Streaming queries: a table is read as a stream of files until nothing is left, and the result is what the stream has kept."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from ..streaming import snapshots as N
from .bindings import query, table


def stream_of(spark, d, name):
    return N.read_snapshots(spark, f"{d}/{name}.parque[t]", table(spark, d, name).schema)


@query("stream_upsert", "SELECT user_id AS id, event_id AS seq, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def stream_upsert(spark, d):
    """The last event of each user."""
    at = f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
    rows = stream_of(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type")
    N.upsert(rows, f"{at}/table", f"{at}/progress").awaitTermination()
    return N.current(spark, f"{at}/table", rows.schema)


@query(
    "stream_windows",
    "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, count(DISTINCT user_id) AS ids, count(*) AS \"rows\" FROM events GROUP BY 1 HAVING time_bucket(INTERVAL 10 MINUTE, min(ts)) + INTERVAL 10 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
)
def stream_windows(spark, d):
    """Users and events in each window that the watermark has closed."""
    at = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    rows = stream_of(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("id"))
    got = N.changes_per_window(rows, "ts").select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "ids", "rows")
    got.writeStream.outputMode("append").format("parquet").option("path", f"{at}/table").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(got.schema).parquet(f"{at}/table")


@query(
    "stream_sessions",
    """WITH t AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM t)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end, count(*) AS "rows" FROM s GROUP BY user_id, n HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def stream_sessions(spark, d):
    """Runs of a user's events of which each follows within 12 hours, as far as the watermark has closed them."""
    at = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    rows = stream_of(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    got = N.sessions(rows, "user_id", "ts", "12 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("session_start"), F.col("end").cast("timestamp_ntz").alias("session_end"), "rows")
    got.writeStream.outputMode("append").format("parquet").option("path", f"{at}/table").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(got.schema).parquet(f"{at}/table")
