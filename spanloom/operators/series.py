"""Time-series operators: rate, counts over time, heatmap, quantile, aggregation.

A matrix is a long DataFrame (labels, time_ns, value); labels are sorted entries of a label map, so series are grouped
on structured values and never on joined text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.labels import all_labels, by_key, canonical, label, metric_labels, sorted_entries

_NO_LABELS = "array<struct<key:string,value:string>>"


def _rounded(x: Column) -> Column:
    return F.round(x, 6)


def range_scan(spans: DataFrame, start: int, end: int, lookback: int) -> DataFrame:
    """Spans that start in [start - lookback, end], not before the epoch."""
    return spans.where(F.col("start_time").between(max(start - lookback, 0), end))


def rate(spans: DataFrame, start: int, end: int, step: int, lookback: int) -> DataFrame:
    """Spans a second in [s - lookback, s) for every step s from start to end (included), by series.

    Each span belongs to a run of steps lo..hi.  Spans are first counted by (series, lo, hi), of which a step cell has at most two,
    and only those counts are repeated for each step: the shuffle carries cells, not spans times steps.
    """
    if lookback <= 0 or step <= 0:
        raise ValueError("rate needs a range and a step above zero")
    t = F.col("start_time") - F.lit(start)
    last = (end - start) // step
    lo = F.greatest(F.lit(0), scalar.step_index(t, step) + 1)
    hi = F.least(F.lit(last), scalar.step_index(t + F.lit(lookback), step))
    d = spans.where(F.col("start_time").between(start - lookback, end))
    d = d.select(sorted_entries(metric_labels()).alias("labels"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi")).where("lo <= hi")
    cells = d.groupBy("labels", "lo", "hi").agg(F.count("*").alias("n"))
    steps = cells.select("labels", F.explode(F.sequence("lo", "hi")).alias("k"), "n").groupBy("labels", "k").agg(F.sum("n").alias("n"))
    seconds = lookback / scalar.SECOND
    return steps.select("labels", (F.lit(start) + F.col("k") * F.lit(step)).alias("time_ns"), _rounded(F.col("n") / F.lit(seconds)).alias("value"))


def count_over_time(spans: DataFrame, start: int, end: int, step: int) -> DataFrame:
    """Spans by series and tumbling step of [start, end)."""
    if step <= 0:
        raise ValueError("the step must be above zero")
    d = spans.where((F.col("start_time") >= start) & (F.col("start_time") < end))
    k = scalar.step_index(F.col("start_time") - F.lit(start), step)
    d = d.groupBy(sorted_entries(metric_labels()).alias("labels"), k.alias("k")).agg(F.count("*").alias("n"))
    return d.select("labels", (F.lit(start) + F.col("k") * F.lit(step)).alias("time_ns"), F.col("n").cast("double").alias("value"))


def heatmap(spans: DataFrame) -> DataFrame:
    """(bucket1s, duration_bucket, count)."""
    return spans.groupBy("bucket1s", "duration_bucket").agg(F.count("*").alias("count"))


def heatmap_matrix(spans: DataFrame) -> DataFrame:
    b = F.col("duration_bucket")
    labels = F.array(F.struct(F.lit("duration_bucket").alias("key"), b.cast("string").alias("value")), F.struct(F.lit("duration_range").alias("key"), scalar.duration_range(b).alias("value")))
    return heatmap(spans).select(labels.alias("labels"), F.col("bucket1s").alias("time_ns"), F.col("count").cast("double").alias("value"))


def heatmap_grid(spans: DataFrame, step: int, times: Sequence[int]) -> DataFrame:
    """Dense grid: a row for each duration bucket, a column ``t<seconds>`` for each of the time steps that begin at ``times`` (ns), counts inside."""
    t = F.col("start_time") - F.pmod(F.col("start_time"), F.lit(step))
    return spans.groupBy("duration_bucket").agg(*(F.count(F.when(t == x, 1)).alias(f"t{x // scalar.SECOND}") for x in times))


def quantile(spans: DataFrame, q: float, at: int) -> DataFrame:
    """Middle of the first duration bucket whose running count reaches trunc(total * q); 0 without spans."""
    if not 0 <= q <= 1:
        raise ValueError("the quantile must be between 0 and 1")
    counts = spans.groupBy("duration_bucket").agg(F.count("*").alias("n"))  # at most 64 rows go on
    run = W.orderBy("duration_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    d = counts.select("duration_bucket", F.sum("n").over(run).alias("upto"), F.sum("n").over(every).alias("total"))
    target = F.floor(F.col("total") * F.lit(float(q)))
    hit = F.min(F.when(target <= 0, F.lit(0)).when(F.col("upto") >= target, F.col("duration_bucket")))
    d = d.agg(hit.alias("b"))
    value = F.when(F.col("b").isNull(), F.lit(0.0)).otherwise(scalar.bucket_middle(F.col("b")).cast("double"))
    return d.select(value.alias("value"), F.lit(at).cast("long").alias("time_ns"))


#: op -> aggregate over spans; sum counts them, avg is one each, min and max are of durations.
_OVER_SPANS = {
    "sum": lambda: F.count("*").cast("double"),
    "count": lambda: F.count("*").cast("double"),
    "avg": lambda: F.when(F.count("*") > 0, F.lit(1.0)),
    "min": lambda: F.min("duration").cast("double"),
    "max": lambda: F.max("duration").cast("double"),
}
_OVER_VALUES = {"sum": F.sum, "count": lambda c: F.count(c).cast("double"), "avg": F.avg, "min": F.min, "max": F.max}


def aggregate_spans(spans: DataFrame, op: str, kind: str | None, keys: Sequence[str], at: int) -> DataFrame:
    """(series, value, time_ns): one row a group, none without spans."""
    value = _OVER_SPANS[op]()
    if kind == "without":
        kept = F.map_filter(all_labels(), lambda k, _: ~k.isin(*keys)) if keys else all_labels()
        d = spans.groupBy(sorted_entries(kept).alias("labels")).agg(value.alias("value"))
        d = d.withColumn("series", F.array_join(F.transform("labels", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))
    elif keys:
        named = list(dict.fromkeys(keys))
        cols = [f"key_{i}" for i in range(len(named))]
        d = spans.groupBy(*(label(k).alias(c) for k, c in zip(named, cols, strict=True))).agg(value.alias("value"))
        d = d.withColumn("series", by_key(named, cols))
    else:
        d = spans.agg(value.alias("value"), F.count("*").alias("n")).where("n > 0").withColumn("series", F.lit(""))
    return d.select("series", _rounded(F.col("value")).alias("value"), F.lit(at).cast("long").alias("time_ns"))


def aggregate_each(spans: DataFrame, op: str, at: int) -> DataFrame:
    """Without a grouping clause, as observed: every label set, ids included, is its own group."""
    return aggregate_spans(spans, op, "without", (), at)


def aggregate_matrix(matrix: DataFrame, op: str, kind: str | None, keys: Sequence[str]) -> DataFrame:
    """Aggregate values of a matrix at each time, over label subsets."""
    if kind == "without":
        kept = F.filter("labels", lambda e: ~e["key"].isin(*keys)) if keys else F.col("labels")
    elif keys:
        kept = F.filter("labels", lambda e: e["key"].isin(*keys))
    else:
        kept = F.array().cast(_NO_LABELS)
    value = _OVER_VALUES[op](F.col("value"))
    d = matrix.groupBy(kept.alias("labels"), "time_ns").agg(value.alias("value"))
    return d.withColumn("value", _rounded(F.col("value")))


def with_series(matrix: DataFrame) -> DataFrame:
    """(series, time_ns, value) with the canonical text of the labels."""
    return matrix.select(F.array_join(F.transform("labels", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("series"), "time_ns", "value")


def nested(matrix: DataFrame) -> DataFrame:
    """(series, points): points in order of time, one row a series."""
    return with_series(matrix).groupBy("series").agg(F.array_sort(F.collect_list(F.struct("time_ns", "value"))).alias("points"))


def vector(spans: DataFrame, at: int) -> DataFrame:
    """Spans as an instant vector of ones."""
    return spans.select(canonical(metric_labels()).alias("series"), F.lit(1.0).alias("value"), F.lit(at).cast("long").alias("time_ns"))
