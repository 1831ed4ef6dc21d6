"""Trace search, trace documents and trace trees."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar
from ..shared import drop, saved
from .lookups import by_trace_id
from .matchers import Matcher, select, within_duration

#: Doublings after which pointers that still move are on a cycle.
MAX_ROUNDS = 20
_HIDDEN = ("trace_id", "span_id", "parent_span_id", "name")


def search(spans: DataFrame, matchers: Iterable[Matcher] = (), start: int | None = None, end: int | None = None, min_duration: int = 0, max_duration: int = 0, limit: int = 20) -> DataFrame:
    """Spans of the newest ``limit`` traces with a matching span: groups first, then the limit, so no trace is cut."""
    d = within_duration(select(spans, matchers, start, end), min_duration, max_duration)
    top = d.groupBy("trace_id").agg(F.min("start_time").alias("t")).orderBy(F.col("t").desc(), "trace_id").limit(limit)
    return d.join(F.broadcast(top.select("trace_id")), "trace_id", "left_semi")  # at most ``limit`` rows


def summary(spans: DataFrame) -> DataFrame:
    """One row a trace: bounds, duration, root (or first span), number of spans, errors and services."""
    first = F.struct(F.col("parent_span_id").isNotNull().alias("child"), "start_time", "span_id", "service_name", "name")
    d = spans.groupBy("trace_id").agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.count("*").alias("span_count"),
        F.sum(_is_error().cast("long")).alias("error_count"), F.countDistinct("service_name").alias("service_count"), F.min(first).alias("root"),
    )
    ms = F.call_function("div", F.col("end_time") - F.col("start_time"), F.lit(1_000_000))
    return d.select("trace_id", "start_time", "end_time", ms.alias("duration_ms"), "span_count", "error_count", "service_count", F.col("root.service_name").alias("root_service"), F.col("root.name").alias("root_name"))


def _is_error() -> Column:
    return F.coalesce(F.col("tags")["status.code"] == "error", F.lit(False))


def service_stats(spans: DataFrame) -> DataFrame:
    """(trace_id, service_name, span_count, error_count)."""
    return spans.groupBy("trace_id", "service_name").agg(F.count("*").alias("span_count"), F.sum(_is_error().cast("long")).alias("error_count"))


def _ordered(items: Column) -> Column:
    return F.array_sort(F.collect_list(items))


def _traces(spans: DataFrame) -> DataFrame:
    """(trace_id, s): the spans of each trace in order of time, tags as sorted entries; the one grouping under every trace document."""
    item = F.struct("start_time", "span_id", "name", "parent_span_id", "end_time", "duration", "service_name", F.array_sort(F.map_entries("tags")).alias("tags"))
    return spans.groupBy("trace_id").agg(_ordered(item).alias("s"))


def _string_attributes(entries: Column) -> Column:
    return F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))


def search_metadata(spans: DataFrame) -> DataFrame:
    """Search result of a trace: root, bounds, the set of its spans with attributes, statistics by service."""
    d = _traces(spans).withColumns({
        "root": F.array_min(F.transform("s", lambda x: F.struct(x["parent_span_id"].isNotNull().alias("child"), x["start_time"], x["span_id"], x["service_name"].alias("service_name"), x["name"].alias("name")))),
        "first": F.array_min(F.transform("s", lambda x: x["start_time"])), "last": F.array_max(F.transform("s", lambda x: x["end_time"])),
        "services": F.array_sort(F.array_distinct(F.transform("s", lambda x: x["service_name"]))),
    })
    failed = lambda x: F.exists(x["tags"], lambda e: (e["key"] == "status.code") & (e["value"] == "error"))
    own = lambda name: F.filter("s", lambda x: x["service_name"] == name)
    stat = lambda name: F.struct(name.alias("key"), F.struct(F.size(own(name)).cast("long").alias("spanCount"), F.size(F.filter(own(name), lambda x: F.coalesce(failed(x), F.lit(False)))).cast("long").alias("errorCount")).alias("value"))
    span = lambda x: F.struct(x["span_id"].alias("spanID"), x["name"].alias("name"), x["start_time"].cast("string").alias("startTimeUnixNano"), (x["end_time"] - x["start_time"]).cast("string").alias("durationNanos"), _string_attributes(x["tags"]).alias("attributes"))
    ms = F.call_function("div", F.col("last") - F.col("first"), F.lit(1_000_000))
    return d.select(
        F.col("trace_id").alias("traceID"), F.col("root.service_name").alias("rootServiceName"), F.col("root.name").alias("rootTraceName"), F.col("first").cast("string").alias("startTimeUnixNano"),
        ms.alias("durationMs"), F.array(F.struct(F.transform("s", span).alias("spans"), F.size("s").alias("matched"))).alias("spanSets"), F.map_from_entries(F.transform("services", stat)).alias("serviceStats"),
    )


# ---------------------------------------------------------------- documents


def _typed(entries: Column) -> Column:
    return F.transform(entries, lambda e: F.struct(e["key"].alias("key"), scalar.typed_tag_type(e["value"]).alias("type"), e["value"].alias("value")))


_NO_REFERENCES = "array<struct<refType:string,traceID:string,spanID:string>>"
_NO_LOGS = "array<struct<timestamp:bigint,fields:array<struct<key:string,type:string,value:string>>>>"


def documents(spans: DataFrame) -> DataFrame:
    """One document a trace: (traceID, spans, processes).  Microseconds, references, typed tags, a process for each service, numbered by first appearance."""
    d = _traces(spans).withColumn("services", F.array_distinct(F.transform("s", lambda x: x["service_name"])))  # in order of first appearance
    process = lambda name: F.concat(F.lit("p"), F.array_position(F.col("services"), name).cast("string"))
    reference = lambda x: F.struct(F.lit("CHILD_OF").alias("refType"), F.col("trace_id").alias("traceID"), x["parent_span_id"].alias("spanID"))
    shown = lambda x: F.filter(x["tags"], lambda t: ~scalar.is_resource_attribute(t["key"]) & ~t["key"].isin(*_HIDDEN))
    span = lambda x: F.struct(
        F.col("trace_id").alias("traceID"), x["span_id"].alias("spanID"), x["name"].alias("operationName"),
        F.when(x["parent_span_id"].isNotNull(), F.array(reference(x))).otherwise(F.array().cast(_NO_REFERENCES)).alias("references"),
        F.call_function("div", x["start_time"], F.lit(1000)).alias("startTime"), F.call_function("div", x["duration"], F.lit(1000)).alias("duration"),
        _typed(shown(x)).alias("tags"), F.array().cast(_NO_LOGS).alias("logs"), process(x["service_name"]).alias("processID"),
    )
    resource = lambda x: F.transform(F.filter(x["tags"], lambda e: scalar.is_resource_attribute(e["key"])), lambda e: F.struct(e["key"].alias("key"), F.lit("string").alias("type"), e["value"].alias("value")))
    first = lambda name: F.element_at(F.filter("s", lambda x: x["service_name"] == name), 1)
    processes = F.transform("services", lambda name: F.struct(process(name).alias("key"), F.struct(name.alias("serviceName"), resource(first(name)).alias("tags")).alias("value")))
    return d.select(F.col("trace_id").alias("traceID"), F.transform("s", span).alias("spans"), F.map_from_entries(processes).alias("processes"))


def document_spans(spans: DataFrame) -> DataFrame:
    """The spans of :func:`documents`, one row each, with their place ``seq`` in the document."""
    return documents(spans).select(F.posexplode("spans").alias("at", "x")).select("x.*", (F.col("at") + 1).alias("seq"))


def resource_spans(spans: DataFrame) -> DataFrame:
    """Spans in OTLP form, one row for each service of a trace: resource attributes of its first span, and its spans.  ``spans`` may have links."""
    entries = F.array_sort(F.map_entries("tags"))
    own = _string_attributes(F.filter(entries, lambda e: ~scalar.is_resource_attribute(e["key"]) & ~F.exists(F.array(*map(F.lit, _HIDDEN)), lambda h: e["key"].startswith(h))))
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, scalar.SPAN_KINDS)), F.col("tags")["span.kind"]) - 1, F.lit(1))
    links = F.transform("links", lambda x: F.struct(x["linked_trace_id"].alias("traceId"), x["linked_span_id"].alias("spanId"), _string_attributes(x["attributes"]).alias("attributes"))) if "links" in spans.columns else F.array().cast("array<struct<traceId:string,spanId:string>>")
    span = F.struct(
        F.col("start_time").alias("t"), F.col("span_id").alias("spanId"), F.col("trace_id").alias("traceId"), F.coalesce("parent_span_id", F.lit("")).alias("parentSpanId"), F.col("name").alias("name"),
        F.when(kind < 2, F.lit(1)).otherwise(kind).cast("int").alias("kind"), F.col("start_time").cast("string").alias("startTimeUnixNano"), F.col("end_time").cast("string").alias("endTimeUnixNano"), own.alias("attributes"), links.alias("links"), F.struct(F.lit(0).alias("code")).alias("status"),
    )
    head = F.min(F.struct("start_time", "span_id", _string_attributes(F.filter(entries, lambda e: scalar.is_resource_attribute(e["key"]))).alias("a")))
    d = spans.groupBy("trace_id", "service_name").agg(head.alias("h"), _ordered(span).alias("s"))
    scope = F.struct(F.lit("spanloom").alias("name"), F.lit("1.0.0").alias("version"))
    return d.select("trace_id", "service_name", F.struct(F.col("h.a").alias("attributes")).alias("resource"), F.array(F.struct(scope.alias("scope"), F.transform("s", lambda x: x.dropFields("t")).alias("spans"))).alias("scopeSpans"))


def export_requests(spans: DataFrame) -> DataFrame:
    """(trace_id, value): one OTLP/JSON export request a trace, which :mod:`spanloom.sources.otlp` reads back."""
    d = resource_spans(spans).groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("service_name", F.struct("resource", "scopeSpans").alias("r")))).alias("r"))
    return d.select("trace_id", F.to_json(F.struct(F.transform("r", lambda x: x["r"]).alias("resourceSpans"))).alias("value"))


def detail(spans: DataFrame, trace_id: str) -> DataFrame:
    """Spans of a trace in order of time."""
    d = by_trace_id(spans, trace_id)
    return d.select("trace_id", "span_id", "parent_span_id", "name", "service_name", "start_time", "end_time", "duration", "tags").orderBy("start_time", "span_id")


# ---------------------------------------------------------------- trees


def with_parent(spans: DataFrame, columns: Sequence[str] = ("name", "service_name", "start_time")) -> DataFrame:
    """Spans whose parent is in their trace, with columns of the parent under ``parent_<name>``."""
    p = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), *(F.col(c).alias(f"parent_{c}") for c in columns))
    return spans.join(p, ["trace_id", "parent_span_id"])


def roots(spans: DataFrame) -> DataFrame:
    return spans.where(F.col("parent_span_id").isNull())


def orphans(spans: DataFrame) -> DataFrame:
    """Spans whose parent is not in their trace."""
    have = spans.select("trace_id", F.col("span_id").alias("parent_span_id"))
    return spans.where(F.col("parent_span_id").isNotNull()).join(have, ["trace_id", "parent_span_id"], "left_anti")


def tree(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, parent_span_id (null for roots and orphans), depth, root_span_id, sibling (place among siblings by time).

    Pointer jumping: each round doubles the distance a span knows to an ancestor, so a chain of n spans needs log2(n)
    joins.  Spans on a cycle, or below one, never reach a root: after ``MAX_ROUNDS`` (a depth of 2 ** 20) they stay where they are.
    """
    have = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("known"))
    d = spans.select("trace_id", "span_id", "parent_span_id", "start_time").join(have, ["trace_id", "parent_span_id"], "left")
    d = d.withColumn("parent_span_id", F.when(F.col("known"), F.col("parent_span_id"))).drop("known")
    return _depths(d)


def _depths(d: DataFrame) -> DataFrame:
    """Pointers are jumped over until all of them rest at a root, so rounds follow the depth of the deepest tree and not the size of a trace.
    Each round is a table of its own: spans that have arrived are set aside, plans stay small, and a lost executor costs the round's tasks."""
    spark = d.sparkSession
    root = F.col("parent_span_id").isNull()
    up, path = saved(d.select("trace_id", "span_id", F.coalesce("parent_span_id", "span_id").alias("up"), F.when(root, 0).otherwise(1).alias("depth"), root.alias("there")), "tree")
    for _ in range(MAX_ROUNDS):
        if up.where("not there").isEmpty():
            break
        above = up.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("there").alias("there2"))
        moved = up.where("not there").join(above, ["trace_id", "up"]).select("trace_id", "span_id", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), F.col("there2").alias("there"))
        further, further_path = saved(up.where("there").unionByName(moved), "tree")
        drop(spark, path)
        up, path = further, further_path
    sibling = F.row_number().over(W.partitionBy("trace_id", "parent_span_id").orderBy("start_time", "span_id"))
    out = d.join(up, ["trace_id", "span_id"])
    return out.select("trace_id", "span_id", "parent_span_id", "depth", F.col("up").alias("root_span_id"), sibling.alias("sibling"))


def flattened(spans: DataFrame, trace_id: str, collapsed: Sequence[str] = ()) -> DataFrame:
    """The rows a tree view of one trace shows: depth-first by time, nothing below collapsed spans.

    The way from the root is an array of sibling places; ordering by it is depth-first order."""
    own = by_trace_id(spans, trace_id)
    have = own.select(F.col("span_id").alias("parent_span_id"), F.lit(True).alias("known"))
    d = own.join(have, "parent_span_id", "left").withColumn("parent_span_id", F.when(F.col("known"), F.col("parent_span_id")))
    w = W.partitionBy("parent_span_id").orderBy("start_time", "span_id")
    d = d.select("span_id", "parent_span_id", "name", "service_name", "start_time", "duration", F.row_number().over(w).alias("place"))
    spark = spans.sparkSession
    d.createOrReplaceTempView("__trace_rows")
    hidden = ", ".join("'" + c.replace("'", "") + "'" for c in collapsed) or "''"
    return spark.sql(f"""
        WITH RECURSIVE way(span_id, depth, path, hidden) AS (
          SELECT span_id, 0, array(place), span_id IN ({hidden}) FROM __trace_rows WHERE parent_span_id IS NULL
          UNION ALL
          SELECT r.span_id, w.depth + 1, concat(w.path, array(r.place)), r.span_id IN ({hidden})
          FROM __trace_rows r JOIN way w ON r.parent_span_id = w.span_id WHERE NOT w.hidden)
        SELECT r.*, w.depth, w.path FROM way w JOIN __trace_rows r USING (span_id) ORDER BY w.path""").drop("place")


def ancestors(spans: DataFrame, trace_id: str, span_id: str) -> list[str]:
    """Ids from a span's parent up to its root."""
    parent = {r.span_id: r.parent_span_id for r in by_trace_id(spans, trace_id).select("span_id", "parent_span_id").collect()}  # one trace
    out, at = [], parent.get(span_id)
    while at in parent and at not in out:
        out.append(at)
        at = parent[at]
    return out
