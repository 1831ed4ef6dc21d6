"""Point and batch lookups, unions of sources, links, attribute tables and discovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import label
from .matchers import overlaps

#: Rows of an id list up to which it is broadcast.
MAX_BROADCAST_IDS = 100_000


def by_span_id(spans: DataFrame, span_id: str) -> DataFrame:
    return spans.where(F.col("span_id") == span_id.lower().rjust(16, "0"))


def by_trace_id(spans: DataFrame, trace_id: str) -> DataFrame:
    return spans.where(F.col("trace_id") == trace_id.lower().rjust(32, "0"))


def by_tag(spans: DataFrame, key: str, value: str) -> DataFrame:
    return spans.where(label(key) == value)


def by_span_ids(spans: DataFrame, ids: Sequence[str] | DataFrame) -> DataFrame:
    """Semi join with a list or a one-column table of ids; only short lists are broadcast."""
    if isinstance(ids, DataFrame):
        return spans.join(ids.toDF("span_id").distinct(), "span_id", "left_semi")
    own = spans.sparkSession.createDataFrame([(i.lower().rjust(16, "0"),) for i in ids], "span_id string").distinct()
    return spans.join(F.broadcast(own) if len(ids) <= MAX_BROADCAST_IDS else own, "span_id", "left_semi")


def attribute_ids(spans: DataFrame, key: str, value: str) -> DataFrame:
    """Ids of the spans that have an attribute value."""
    return spans.where(F.col("tags")[key] == value).select("span_id")


def attribute_ids_batch(spans: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(pair, span_id) for several attribute values at once, in one pass over the tags and without a shuffle."""
    wanted = [f"{k}={v}" for k, v in pairs]
    return spans.select(F.explode(F.filter(F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), lambda p: p.isin(*wanted))).alias("pair"), "span_id")


def attributes(spans: DataFrame) -> DataFrame:
    """(span_id, key, value): the tags, one row each."""
    return spans.select("span_id", F.explode("tags").alias("key", "value"))


def wide_attributes(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """span_id and one column ``__attr_<key>`` for each key; no pivot and no shuffle, tags are read in place."""
    return spans.select("span_id", *(F.col("tags")[k].alias(f"__attr_{k}") for k in keys))


def with_attributes(spans: DataFrame, attrs: DataFrame) -> DataFrame:
    """Lay (span_id, key, value) rows over the spans' tags; the attribute wins."""
    m = attrs.groupBy("span_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("more"))
    d = spans.join(m, "span_id", "left")
    base = F.coalesce("tags", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys("more"), k)), F.col("more"))
    return d.withColumn("tags", F.when(F.col("more").isNull(), F.col("tags")).otherwise(merged)).drop("more")


def present_keys(spans: DataFrame) -> DataFrame:
    """Attribute keys with at least one value."""
    return spans.select(F.explode("tags").alias("key", "value")).where(F.col("value").isNotNull()).select("key").distinct()


def nested_links(links: DataFrame) -> DataFrame:
    item = F.struct("linked_trace_id", "linked_span_id", F.array_sort(F.map_entries("attributes")).alias("attributes"))
    return links.groupBy("span_id").agg(F.array_sort(F.collect_list(item)).alias("links"))


def with_links(spans: DataFrame, links: DataFrame) -> DataFrame:
    """Spans with an array of their links, empty where there are none."""
    d = spans.join(nested_links(links), "span_id", "left")
    return d.withColumn("links", F.coalesce("links", F.expr("cast(array() as array<struct<linked_trace_id:string,linked_span_id:string,attributes:array<struct<key:string,value:string>>>>)")))


def trace_links(spans: DataFrame, links: DataFrame, trace_id: str) -> DataFrame:
    return links.join(by_trace_id(spans, trace_id).select("span_id"), "span_id", "left_semi")


def link_targets(spans: DataFrame, links: DataFrame) -> DataFrame:
    """Each link with the span it points to."""
    t = spans.select(F.col("trace_id").alias("linked_trace_id"), F.col("span_id").alias("linked_span_id"), F.col("name").alias("target_name"), F.col("service_name").alias("target_service"), F.col("start_time").alias("target_start"))
    return links.join(t, ["linked_trace_id", "linked_span_id"])


def union_first(*sources: DataFrame, by: Sequence[str] = ("span_id",)) -> DataFrame:
    """Union of sources in which the first source with a span id wins."""
    every = None
    for rank, d in enumerate(sources):
        d = d.withColumn("__rank", F.lit(rank))
        every = d if every is None else every.unionByName(d)
    w = W.partitionBy(*by).orderBy("__rank", "start_time", "trace_id")
    return every.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__rank")


def deduplicated(spans: DataFrame) -> DataFrame:
    """One row for each (trace_id, span_id), the earliest."""
    w = W.partitionBy("trace_id", "span_id").orderBy("start_time", "end_time", "name")
    return spans.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def visible(spans: DataFrame, snapshot: int) -> DataFrame:
    """Rows committed up to a snapshot; rows without a sequence number were never tracked and are visible."""
    return spans.where(F.col("commit_seq").isNull() | (F.col("commit_seq") <= snapshot))


# ---------------------------------------------------------------- discovery


def services(spans: DataFrame, start: int, end: int) -> DataFrame:
    return spans.where(overlaps(start, end) & (F.col("service_name") != "")).select("service_name").distinct().orderBy("service_name")


def operations(spans: DataFrame, start: int, end: int, service: str | None = None) -> DataFrame:
    d = spans.where(overlaps(start, end))
    if service:
        d = d.where(F.col("service_name") == service)
    return d.select("name").distinct().orderBy("name")


def attribute_keys(spans: DataFrame, start: int, end: int, limit: int = 1000) -> DataFrame:
    """(key, limited): sorted keys; ``limited`` says that there are more than the limit."""
    d = spans.where(overlaps(start, end)).select(F.explode(F.map_keys("tags")).alias("key")).distinct()
    return _limited(d, "key", limit)


def _values(spans: DataFrame, key: str, start: int, end: int) -> DataFrame:
    return spans.where(overlaps(start, end)).select(label(key).alias("value")).where(F.col("value").isNotNull()).distinct()


def attribute_values(spans: DataFrame, key: str, start: int, end: int, limit: int = 1000) -> DataFrame:
    return _limited(_values(spans, key, start, end), "value", limit)


def tag_names(spans: DataFrame, start: int, end: int) -> DataFrame:
    return spans.where(overlaps(start, end)).select(F.explode(F.map_keys("tags")).alias("key")).distinct().orderBy("key")


def tag_values(spans: DataFrame, name: str, start: int, end: int) -> DataFrame:
    """All values of a tag named with or without ``resource.``, ``span.`` or a leading dot."""
    for prefix in (".", "resource.", "span."):
        name = name.removeprefix(prefix)
    return _values(spans, name, start, end).orderBy("value")


def _limited(d: DataFrame, column: str, limit: int) -> DataFrame:
    top = d.orderBy(column).limit(limit + 1)  # one more than asked for tells whether there are more
    n = F.count("*").over(W.partitionBy())
    return top.withColumn("limited", n > limit).orderBy(column).limit(limit)


def stats(spans: DataFrame) -> DataFrame:
    """Totals of spans, traces, attribute keys and key-value pairs."""
    head = spans.agg(F.count("*").alias("total_spans"), F.countDistinct("trace_id").alias("total_traces"))
    tags = attributes(spans).agg(F.countDistinct("key").alias("tag_keys"), F.countDistinct("key", "value").alias("tag_values"))
    return head.crossJoin(tags)  # two single rows


