"""Spans and links derived from event tables (any table with an id, a time, a user, a type and a value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import hex_id
from ..schema import with_generated


def spans_from_events(events: DataFrame) -> DataFrame:
    """One span for each event; a user's events of a day are a trace, each the child of the one before."""
    ts = F.col("ts").cast("timestamp")
    start = F.unix_micros(ts) * 1000
    day = F.call_function("div", F.unix_micros(ts), F.lit(86_400_000_000))
    d = events.select(
        F.concat(hex_id(F.col("user_id")), hex_id(day)).alias("trace_id"),
        hex_id(F.col("event_id") + 1).alias("span_id"),
        F.col("event_type").alias("name"),
        start.alias("start_time"),
        (F.round(F.col("value") * 1000).cast("long") * 1000).alias("duration"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("service_name"),
        F.col("props"),
    )
    k = F.get_json_object("props", "$.k")
    error = F.col("name") == "error"
    tags = F.map_filter(
        F.create_map(
            F.lit("k"), k,
            F.lit("span.kind"), F.when(F.col("name").isin("click", "view"), "server").otherwise("client"),
            F.lit("status.code"), F.when(error, "error"),
            F.lit("service.name"), F.col("service_name"),
            F.lit("host.id"), F.concat(F.lit("h"), k),
        ), lambda _, v: v.isNotNull(),
    )
    chain = W.partitionBy("trace_id").orderBy("start_time", "span_id")
    d = d.withColumn("parent_span_id", F.lag("span_id").over(chain)).withColumn("end_time", F.col("start_time") + F.col("duration")).withColumn("tags", tags)
    return with_generated(d.select("trace_id", "span_id", "parent_span_id", "name", "start_time", "end_time", "duration", "service_name", "tags"))


def links_from_events(events: DataFrame) -> DataFrame:
    """Each purchase is linked with the last click of the same user before it."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    day = F.call_function("div", ts, F.lit(86_400_000_000))
    own = F.struct(F.concat(hex_id(F.col("user_id")), hex_id(day)).alias("trace_id"), hex_id(F.col("event_id") + 1).alias("span_id"))
    d = events.select("user_id", "event_type", ts.alias("t"), F.col("event_id"), own.alias("own"))
    before = W.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("click", F.last(F.when(F.col("event_type") == "click", F.col("own")), ignorenulls=True).over(before))
    d = d.where((F.col("event_type") == "purchase") & F.col("click").isNotNull())
    return d.select(F.col("own.span_id"), F.col("click.trace_id").alias("linked_trace_id"), F.col("click.span_id").alias("linked_span_id"), F.create_map(F.lit("reason"), F.lit("last-click")).alias("attributes"))
