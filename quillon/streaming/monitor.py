"""Refusals over time from the trace log as a stream; an extension, the log itself is a batch source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TRACE


def trace_stream(spark: SparkSession, path: str) -> DataFrame:
    """New trace files under ``path`` as they come."""
    return spark.readStream.schema(TRACE).json(path)


def refusal_rates(traces: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, end, n, refused, refusal_rate) of each window; traces later than ``late`` are not counted."""
    timed = traces.withColumn("at", F.timestamp_seconds("timestamp")).withWatermark("at", late)
    by = timed.groupBy(F.window("at", window)).agg(F.count("*").alias("n"), F.count_if("refused").alias("refused"))
    return by.select("window.start", "window.end", "n", "refused", (F.col("refused") / F.col("n")).alias("refusal_rate"))
