"""Continuous forms of the series operators: event-time windows with a watermark for late spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_time(ns: Column) -> Column:
    return F.timestamp_micros(F.call_function("div", ns, F.lit(1000)))


def _timed(spans: DataFrame, watermark: str) -> DataFrame:
    return spans.withColumn("ts", event_time(F.col("start_time"))).withWatermark("ts", watermark)


def rate(spans: DataFrame, lookback: str, step: str, seconds: float, keys: tuple[str, ...] = ("service_name", "name"), watermark: str = "10 minutes") -> DataFrame:
    """Sliding-window rate, stamped at the end of its window (microsecond times)."""
    d = _timed(spans, watermark).groupBy(F.window("ts", lookback, step), *keys).agg(F.count("*").alias("n"))
    return d.select(*keys, (F.unix_micros(F.col("window.end")) * 1000).alias("time_ns"), F.round(F.col("n") / F.lit(seconds), 6).alias("value"))


def heatmap(spans: DataFrame, width: str = "1 second", watermark: str = "10 minutes") -> DataFrame:
    d = _timed(spans, watermark).groupBy(F.window("ts", width), "duration_bucket").agg(F.count("*").alias("count"))
    return d.select((F.unix_micros(F.col("window.start")) * 1000).alias("time_ns"), "duration_bucket", "count")


def sessions(spans: DataFrame, gap: str, key: str = "service_name", watermark: str = "10 minutes") -> DataFrame:
    """Activity sessions of a key: stretches without a pause longer than ``gap``."""
    d = _timed(spans, watermark).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return d.select(key, (F.unix_micros(F.col("session_window.start")) * 1000).alias("start_ns"), (F.unix_micros(F.col("session_window.end")) * 1000).alias("end_ns"), "n")
