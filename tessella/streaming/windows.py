"""Structured Streaming over event tables: an extension, kept apart from the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", max_files: int = 100) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", max_files).load(path)


def _timed(events: DataFrame, ts: str) -> DataFrame:
    """Event times without a zone are read in the session's zone: watermarks need instants."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed(events: DataFrame, ts: str, keys: list[str], value: str, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window; what comes later than ``late`` is dropped. Works on batches too."""
    frame = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (
        _timed(events, ts).withWatermark(ts, late).groupBy(frame.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")
    )


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = F.session_window(ts, gap)
    return _timed(events, ts).withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Work off all that is there, then stop; exactly once into Parquet."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
