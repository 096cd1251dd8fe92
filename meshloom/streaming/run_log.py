"""Structured Streaming over a growing run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.sources.files import run_log_schema


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(run_log_schema()).json(path)


def best_times(stream: DataFrame, method: str = "BFS") -> DataFrame:
    """Least labelling time per mesh and process count so far; for update or complete mode."""
    return stream.groupBy("mesh_idx", "np").agg(F.min(f"{method}_labeling_time").alias("best"), F.count(F.lit(1)).alias("runs"))


def windowed_values(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Tumbling counts and sums of an event stream with ts, event_type and value, under a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def cache_runs(spark: SparkSession, logs: str, cache: str, progress: str) -> None:
    """Brings the runs of new files below ``logs`` into the table ``cache``, each file once, and returns when none is left.

    Which files were taken is kept below ``progress``, and the table's own log tells which
    of its files count, so a restart after a failure neither repeats nor loses a run."""
    rows = spark.readStream.schema(run_log_schema()).json(logs)
    query = rows.writeStream.format("parquet").option("checkpointLocation", progress).option("path", cache).trigger(availableNow=True).start()
    query.awaitTermination()
