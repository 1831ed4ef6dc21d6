"""OTLP/JSON trace exports as spans and links; works on batch and streaming DataFrames of JSON texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import attribute_text, span_kind, status_code
from ..schema import with_generated

_ANY = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double,arrayValue:struct<values:array<string>>,kvlistValue:struct<values:array<string>>,bytesValue:string>"
_ATTRS = f"array<struct<key:string,value:{_ANY}>>"
_LINK = f"struct<traceId:string,spanId:string,attributes:{_ATTRS}>"
_SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRS},status:struct<code:string,message:string>,links:array<{_LINK}>>"
_SCOPE = f"struct<scope:struct<name:string,version:string,attributes:{_ATTRS}>,spans:array<{_SPAN}>>"
REQUEST = f"struct<resourceSpans:array<struct<resource:struct<attributes:{_ATTRS}>,scopeSpans:array<{_SCOPE}>>>>"


def _map(attrs: Column, prefix: str = "") -> Column:
    """Attributes as a map of texts; of a repeated key the last one holds."""
    pairs = F.transform(F.coalesce(attrs, F.array().cast(_ATTRS)), lambda a: F.struct(F.concat(F.lit(prefix), a["key"]).alias("key"), attribute_text(a["value"]).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def _over(*maps: Column) -> Column:
    """Maps laid over each other; later ones win."""
    return reduce(lambda low, high: F.map_concat(F.map_filter(low, lambda k, _: ~F.array_contains(F.map_keys(high), k)), high), maps)


def _one(key: str, value: Column, when: Column | None = None) -> Column:
    full = F.create_map(F.lit(key), value)
    return full if when is None else F.when(when, full).otherwise(F.create_map().cast("map<string,string>"))


def _exploded(requests: DataFrame, column: str) -> DataFrame:
    d = requests.select(F.from_json(F.col(column), REQUEST).alias("r"))
    d = d.select(F.explode("r.resourceSpans").alias("rs"))
    d = d.select(F.col("rs.resource.attributes").alias("res"), F.explode("rs.scopeSpans").alias("ss"))
    return d.select("res", F.col("ss.scope").alias("scope"), F.explode("ss.spans").alias("s"))


def spans(requests: DataFrame, column: str = "value") -> DataFrame:
    """Spans of all requests.  Later tags win: resource, scope (under ``scope.``), span, kind, status, service, name, parent."""
    d = _exploded(requests, column)
    scope = _over(_map(F.col("scope.attributes"), "scope."), _one("scope.name", F.col("scope.name"), F.coalesce(F.col("scope.name") != "", F.lit(False))), _one("scope.version", F.col("scope.version"), F.coalesce(F.col("scope.version") != "", F.lit(False))))
    parent = F.nullif(F.col("s.parentSpanId"), F.lit(""))
    d = d.withColumn("base", _over(_map(F.col("res")), scope, _map(F.col("s.attributes")), _one("span.kind", span_kind(F.col("s.kind"))), _one("status.code", status_code(F.col("s.status.code"))), _one("status.message", F.col("s.status.message"), F.coalesce(F.col("s.status.message") != "", F.lit(False)))))
    d = d.withColumn("service_name", F.coalesce(F.nullif(F.col("base")["service.name"], F.lit("")), F.lit("unknown-service")))
    tags = _over(F.col("base"), _one("service.name", F.col("service_name")), _one("name", F.coalesce("s.name", F.lit(""))), _one("parent_span_id", F.lower(F.lpad(parent, 16, "0")), parent.isNotNull()))
    start, end = F.col("s.startTimeUnixNano").cast("long"), F.col("s.endTimeUnixNano").cast("long")
    return with_generated(d.select(
        F.lpad(F.lower("s.traceId"), 32, "0").alias("trace_id"), F.lpad(F.lower("s.spanId"), 16, "0").alias("span_id"), F.lpad(F.lower(parent), 16, "0").alias("parent_span_id"),
        F.coalesce("s.name", F.lit("")).alias("name"), start.alias("start_time"), end.alias("end_time"), (end - start).alias("duration"), "service_name", tags.alias("tags"),
    ))


def links(requests: DataFrame, column: str = "value") -> DataFrame:
    d = _exploded(requests, column).select(F.lpad(F.lower("s.spanId"), 16, "0").alias("span_id"), F.explode("s.links").alias("l"))
    return d.select("span_id", F.lpad(F.lower("l.traceId"), 32, "0").alias("linked_trace_id"), F.lpad(F.lower("l.spanId"), 16, "0").alias("linked_span_id"), _map(F.col("l.attributes")).alias("attributes"))
