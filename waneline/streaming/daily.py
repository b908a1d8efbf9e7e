"""Series from an event stream: daily values under a watermark, kept as a series table for refits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_values(events: DataFrame, key: str = "event_type", ts: str = "ts", value: str = "value", late: str = "2 days") -> DataFrame:
    """series_id, date, value: the sum of each key and day; rows later than the watermark are dropped by Spark."""
    stream = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        stream = stream.withWatermark(ts, late)
    days = stream.groupBy(F.window(ts, "1 day"), F.col(key).alias("series_id")).agg(F.sum(value).alias("value"))
    return days.select("series_id", F.col("window.start").cast("date").alias("date"), "value")


def keep_series(days: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write closed days to Parquet under ``path``, once each; late data can only change days still open."""
    return days.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """The series table a stream has written so far."""
    return spark.read.parquet(path).select("series_id", "date", "value")
