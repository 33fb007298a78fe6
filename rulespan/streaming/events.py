"""An extension: windowed counts of events, the same code for a table and for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(hour, event_type, n, total) of tumbling windows; a stream drops what comes later than ``late``.

    Watermarks want a time with a zone: a stream reads other times in the session's zone and gives them back in it.
    """
    kind = events.schema["ts"].dataType
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = events.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").cast(kind).alias("hour"), "event_type", "n", "total")


def read(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """The Parquet files that arrive in ``folder`` as a stream with the schema of ``like``."""
    return spark.readStream.schema(like.schema).parquet(folder)
