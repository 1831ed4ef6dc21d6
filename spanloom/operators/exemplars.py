"""Exemplar spans for each step of a query, and their join with series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.labels import metric_labels, sorted_entries

MAX_PER_STEP = 100


def fetch_limit(count: int, heatmap: bool = False) -> int:
    """How many spans a bounded fetch of candidates takes: 30 (300) for each exemplar, 50 to 1000."""
    return min(1000, max(50, count * (300 if heatmap else 30)))


def _order(strategy: str) -> list[Column]:
    if strategy == "slowest":
        return [F.col("duration").desc(), F.col("trace_id"), F.col("span_id")]
    if strategy == "fastest":
        return [F.col("duration"), F.col("trace_id"), F.col("span_id")]
    if strategy == "random":
        return [F.xxhash64("trace_id", "span_id"), F.col("trace_id"), F.col("span_id")]  # random, but the same each time
    raise ValueError(f"unknown strategy {strategy!r}")


def _top(d: DataFrame, keys: list[str], count: int, strategy: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*_order(strategy))
    d = d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= min(count, MAX_PER_STEP))
    return d.select(*keys, "rank", "trace_id", "span_id", "service_name", "name", "start_time", "duration", *(c for c in ("duration_bucket", "labels") if c in d.columns and c not in keys))


def _labelled(spans: DataFrame) -> DataFrame:
    return spans.withColumn("labels", sorted_entries(metric_labels()))


def by_step(spans: DataFrame, start: int, end: int, step: int, count: int = 1, strategy: str = "slowest", by_series: bool = False) -> DataFrame:
    """Of the spans that start in each tumbling step of [start, end)."""
    k = scalar.step_index(F.col("start_time") - F.lit(start), step)
    d = spans.where((F.col("start_time") >= start) & (F.col("start_time") < end)).withColumn("bucket", F.lit(start) + k * F.lit(step))
    return _top(_labelled(d), ["labels", "bucket"], count, strategy) if by_series else _top(d, ["bucket"], count, strategy)


def with_lookback(spans: DataFrame, start: int, end: int, step: int, lookback: int, count: int = 1, strategy: str = "slowest", by_series: bool = False) -> DataFrame:
    """Of the spans that start in [s - lookback, s) for each step s from start to end (included).

    A span can only be chosen in a step if it is among the first of its own step cell, so cells are cut to ``count`` before spans
    are repeated for the steps they belong to.
    """
    t = F.col("start_time") - F.lit(start)
    d = spans.where(F.col("start_time").between(start - lookback, end))
    lo = F.greatest(F.lit(0), scalar.step_index(t, step) + 1).cast("long")
    hi = F.least(F.lit((end - start) // step), scalar.step_index(t + F.lit(lookback), step)).cast("long")
    d = d.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi")
    keys = []
    if by_series:
        d, keys = _labelled(d), ["labels"]
    w = W.partitionBy(*keys, "lo", "hi").orderBy(*_order(strategy))
    d = d.withColumn("r", F.row_number().over(w)).where(F.col("r") <= min(count, MAX_PER_STEP))
    d = d.withColumn("k", F.explode(F.sequence("lo", "hi"))).withColumn("bucket", F.lit(start) + F.col("k") * F.lit(step))
    return _top(d, [*keys, "bucket"], count, strategy)


def by_cell(spans: DataFrame, start: int, end: int, step: int, count: int = 1, strategy: str = "slowest") -> DataFrame:
    """Of the spans of each (time step, duration bucket) cell."""
    k = scalar.step_index(F.col("start_time") - F.lit(start), step)
    d = spans.where((F.col("start_time") >= start) & (F.col("start_time") < end)).withColumn("bucket", F.lit(start) + k * F.lit(step))
    return _top(d, ["bucket", "duration_bucket"], count, strategy)


def attached(matrix: DataFrame, exemplars: DataFrame, by: tuple[str, ...] = ("labels",)) -> DataFrame:
    """Series points with the exemplars of their step and series (or, with ``by=()``, of their step alone)."""
    e = exemplars.groupBy(*by, F.col("bucket").alias("time_ns")).agg(F.array_sort(F.collect_list(F.struct("rank", "trace_id", "span_id", "duration"))).alias("exemplars"))
    return matrix.join(e, [*by, "time_ns"], "left")


def in_duration_bucket(exemplars: DataFrame, bucket: int) -> DataFrame:
    """Exemplars whose duration lies within a duration bucket."""
    low = (1 << bucket) if bucket < 62 else 1 << 62
    high = (1 << (bucket + 1)) if bucket < 62 else scalar.MAX_LONG
    return exemplars.where((F.col("duration") >= low) & (F.col("duration") < high))
