"""Operations metrics over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Stream of Parquet event files that arrive in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def error_rates(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Per window: events, errors and mean value; an event counts once by id, and up to ``late`` behind the newest."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    g = once.groupBy(F.window("ts", window).alias("w"))
    return g.agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.avg("value").alias("mean_value")).select(
        F.col("w.start").alias("start"), "events", "errors", "mean_value"
    )
