"""Windowed aggregates of an event stream: one definition for batch tables and for readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteward.sources.tables import table

QUERIES, SQL = {}, {}


def event_windows(events: DataFrame, every: str = "1 day", late: str | None = None) -> DataFrame:
    """start, event_type, n, total per window; a stream gets a watermark of ``late`` first."""
    rows = events.withWatermark("ts", late) if late else events
    grouped = rows.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_stream(spark, folder: str, schema, sink: str, checkpoint: str, every: str = "1 day", late: str = "2 days"):
    """Reads parquet files of events as they come and appends closed windows to a parquet sink."""
    events = spark.readStream.schema(schema).parquet(folder)
    out = event_windows(events, every, late).writeStream.outputMode("append").format("parquet")
    return out.option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_events(spark, d):
    rows = event_windows(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


QUERIES["event_windows"] = daily_events
SQL["event_windows"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
