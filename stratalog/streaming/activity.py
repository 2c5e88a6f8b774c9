"""Activity over streams of dated events, with watermarks: windows, sessions, and first rows by id.

An extension: the questions of the batch operators, asked of a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, folder: str, schema, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def tumbling_counts(events: DataFrame, ts: str, by: list[str], width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per window and key; a window is final once the watermark has passed it."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, ts: str, by: list[str], gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def first_by_id(events: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Each key's first row within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def to_table(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return rows.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
