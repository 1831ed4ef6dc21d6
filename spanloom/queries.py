"""Registered queries of the trace engine over spans derived from ``events``, each with its SQL.

The window of most queries is the whole month of the data, in steps of an hour, with a lookback of five hours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import sql as spansql
from .functions import labels, scalar
from .operators import exemplars, joins, lookups, series, traces
from .operators.matchers import Matcher, contained, select, within_duration
from .plans.planner import Options, execute
from .schema import with_generated
from .sources.events import links_from_events, spans_from_events
from .streaming import store

START = 1704067200000000000
STEP = 3600 * scalar.SECOND
END = START + 31 * 24 * STEP
BACK = 5 * STEP

#: The derivation of spans and links, in the dialect of the reference queries.
_CTE = """
ev AS (SELECT *, epoch_us(ts) AS us, json_extract_string(props, '$.k') AS k FROM events),
sp0 AS (SELECT lpad(lower(to_hex(user_id)), 16, '0') || lpad(lower(to_hex(us // 86400000000)), 16, '0') AS trace_id,
  lpad(lower(to_hex(event_id + 1)), 16, '0') AS span_id, event_type AS name, us * 1000 AS start_time,
  CAST(round(value * 1000) AS BIGINT) * 1000 AS duration, 'svc-' || (user_id % 5) AS service_name, k, 'h' || k AS host,
  CASE WHEN event_type IN ('click', 'view') THEN 'server' ELSE 'client' END AS kind, CASE WHEN event_type = 'error' THEN 'error' END AS status, user_id, event_id FROM ev),
spans AS (SELECT *, start_time + duration AS end_time, lag(span_id) OVER (PARTITION BY trace_id ORDER BY start_time, span_id) AS parent_span_id,
  start_time - start_time % 1000000000 AS bucket1s, CAST(CASE WHEN duration <= 0 THEN 0 ELSE length(ltrim(bin(duration), '0')) - 1 END AS INT) AS duration_bucket,
  concat_ws(',', '__name__=' || name, 'host.id=' || host, 'k=' || k, 'service.name=' || service_name, 'service_name=' || service_name, 'span.kind=' || kind, 'status.code=' || status) AS series FROM sp0),
lk AS (SELECT span_id, last_value(CASE WHEN name = 'click' THEN trace_id END IGNORE NULLS) OVER w AS linked_trace_id, last_value(CASE WHEN name = 'click' THEN span_id END IGNORE NULLS) OVER w AS linked_span_id, name
  FROM spans WINDOW w AS (PARTITION BY user_id ORDER BY start_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
links AS (SELECT span_id, linked_trace_id, linked_span_id FROM lk WHERE name = 'purchase' AND linked_span_id IS NOT NULL)
"""

_COLS = ("trace_id", "span_id", "parent_span_id", "name", "start_time", "end_time", "duration", "service_name")
_SELECT = "SELECT " + ", ".join(_COLS) + " FROM spans"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
#: Queries as functions of a spans and a links table, wherever these come from.
OVER_TABLES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}
_SQL: dict[str, str] = {}


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spans_from_events(events), links_from_events(events)


def query(name: str, sql: str | None, more: str = ""):
    """Register a function of (spans, links) under a name with its SQL over the derived tables."""

    def register(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable:
        _QUERIES[name] = lambda spark, sf_dir: f(*tables(spark, sf_dir))
        OVER_TABLES[name] = f
        if sql:
            _SQL[name] = f"WITH RECURSIVE {_CTE}{more} {sql}"
        return f

    return register


def _plain(d: DataFrame) -> DataFrame:
    return d.select(*_COLS)


def _run(text: str, **more) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda spans, _: execute(spans, text, Options(START, END, STEP, **more))[1]


def _selector(name: str, text: str, where: str) -> None:
    window = f"end_time >= {START} AND start_time <= {END}"
    query(name, f"{_SELECT} WHERE {window} AND {where}")(lambda s, _: _plain(execute(s, text, Options(START, END))[1]))


#: The trace of one span, whatever the size of the data.
TRACE_SQL = "(SELECT trace_id FROM spans WHERE span_id = '000000000000002a')"


def trace_of(spans: DataFrame, span_id: str = "2a") -> str:
    return lookups.by_span_id(spans, span_id).first().trace_id


# ---------------------------------------------------------------- scans and matchers

query("select_all", _SELECT)(lambda s, _: _plain(s))
_selector("match_eq", '{k="7"}', "k = '7'")
_selector("match_neq_absent", '{status.code!="error"}', "(status IS NULL OR status <> 'error')")
_selector("match_regex", '{name=~"cl.*|view"}', "regexp_full_match(name, 'cl.*|view')")
_selector("match_nregex", '{k!~"[0-4].*"}', "(k IS NULL OR NOT regexp_full_match(k, '[0-4].*'))")
_selector("match_regex_posix", '{host.id=~"h[[:digit:]]+",name=~"(?i)CL\\\\pL+|[v&&i]iew"}', "regexp_full_match(host, 'h[0-9]+') AND regexp_full_match(name, 'cl[a-z]+|view')")
_selector("match_regex_literal", '{name=~"\\\\Qclick\\\\E\\\\z|vie[^]]$"}', "name IN ('click', 'view')")
_selector("match_toplevel", '{service.name="svc-1",name="error"}', "service_name = 'svc-1' AND name = 'error'")
_selector("match_conjunction", '{span.kind="server",k=~"[1-5]"}', "kind = 'server' AND regexp_full_match(k, '[1-5]')")
query("metric_prefix", f"{_SELECT} WHERE name = 'click' AND service_name = 'svc-3' AND end_time >= {START} AND start_time <= {END}")(
    lambda s, _: _plain(execute(s.withColumn("service_name", F.regexp_replace("service_name", "-", "_")), 'svc_3{name="click"}', Options(START, END))[1].withColumn("service_name", F.regexp_replace("service_name", "_", "-")))
)
query("time_overlap", f"{_SELECT} WHERE end_time >= {START + STEP} AND start_time <= {START + 3 * STEP}")(lambda s, _: _plain(select(s, [], START + STEP, START + 3 * STEP)))
query("time_contained", f"{_SELECT} WHERE start_time BETWEEN {START + STEP} AND {START + 3 * STEP}")(lambda s, _: _plain(s.where(contained(START + STEP, START + 3 * STEP))))
query("matrix_selector", f"{_SELECT} WHERE service_name = 'svc-1' AND start_time BETWEEN {START - BACK} AND {END}")(lambda s, _: _plain(execute(s, '{service_name="svc-1"}[5h]', Options(START, END))[1]))
query("span_by_id", f"{_SELECT} WHERE span_id = '000000000000002a'")(lambda s, _: _plain(lookups.by_span_id(s, "2A")))
query("spans_by_ids", f"{_SELECT} WHERE span_id IN ('0000000000000001', '00000000000000ff', '0000000000000100')")(lambda s, _: _plain(lookups.by_span_ids(s, ["1", "ff", "100", "1"])))
query("trace_by_id", f"{_SELECT} WHERE trace_id = {TRACE_SQL}")(lambda s, _: _plain(lookups.by_trace_id(s, trace_of(s))))
query("trace_by_span", f"{_SELECT} WHERE trace_id = {TRACE_SQL}")(lambda s, _: _plain(s.join(lookups.by_span_id(s, "2a").select("trace_id"), "trace_id", "left_semi")))
query("spans_by_tag", f"{_SELECT} WHERE host = 'h12'")(lambda s, _: _plain(lookups.by_tag(s, "host.id", "h12")))
query("attr_first_semijoin", f"{_SELECT} WHERE k = '11' AND name = 'view'")(lambda s, _: _plain(lookups.by_span_ids(s, lookups.attribute_ids(s, "k", "11")).where("name = 'view'")))
query("attr_batch", "SELECT 'k=' || k AS pair, span_id FROM spans WHERE k IN ('3', '4') UNION ALL SELECT 'status.code=' || status, span_id FROM spans WHERE status = 'error'")(
    lambda s, _: lookups.attribute_ids_batch(s, [("k", "3"), ("k", "4"), ("status.code", "error")])
)
query("dedup_fanout", "SELECT span_id, min(src) AS src FROM (SELECT span_id, 'a' AS src FROM spans WHERE duration_bucket < 27 UNION ALL SELECT span_id, 'b' FROM spans WHERE name <> 'view') GROUP BY span_id")(
    lambda s, _: lookups.union_first(s.where("duration_bucket < 27").withColumn("src", F.lit("a")), s.where("name <> 'view'").withColumn("src", F.lit("b"))).select("span_id", "src")
)
query("dedup_spans", "SELECT trace_id, count(*) AS n FROM spans GROUP BY trace_id")(lambda s, _: lookups.deduplicated(s.union(s.where("name = 'click'"))).groupBy("trace_id").agg(F.count("*").alias("n")))
query("snapshot_filter", f"{_SELECT} WHERE event_id % 10 <= 6")(lambda s, _: _plain(lookups.visible(s.withColumn("commit_seq", F.conv("span_id", 16, 10).cast("long") - 1).withColumn("commit_seq", F.col("commit_seq") % 10), 6)))
query("duration_filter", f"{_SELECT} WHERE duration BETWEEN 20000000 AND 60000000")(lambda s, _: _plain(within_duration(s, 20_000_000, 60_000_000)))

# ---------------------------------------------------------------- aggregations

_IN = f"start_time <= {END} AND end_time >= {START}"
_BY = f"SELECT concat_ws(',', 'name=' || name, 'status.code=' || status) AS series, %s AS value, CAST({END} AS BIGINT) AS time_ns FROM spans WHERE {_IN} GROUP BY name, status"
for _op, _value in {"sum": "CAST(count(*) AS DOUBLE)", "avg": "1.0::DOUBLE", "min": "CAST(min(duration) AS DOUBLE)", "max": "CAST(max(duration) AS DOUBLE)", "count": "CAST(count(*) AS DOUBLE)"}.items():
    query(f"{_op}_by", _BY % _value)(_run(_op + " by (name, status.code) ({})"))
query("count_without", f"SELECT concat_ws(',', 'host.id=' || host, 'k=' || k, 'name=' || name, 'service.name=' || service_name, 'service_name=' || service_name, 'span.kind=' || kind, 'status.code=' || status) AS series, CAST(count(*) AS DOUBLE) AS value, CAST({END} AS BIGINT) AS time_ns FROM spans WHERE {_IN} GROUP BY ALL")(_run("count without (trace_id, span_id) ({})"))
query("count_global", f"SELECT '' AS series, CAST(count(*) AS DOUBLE) AS value, CAST({END} AS BIGINT) AS time_ns FROM spans WHERE {_IN} HAVING count(*) > 0")(_run("count({})"))
query("sum_by_empty", f"SELECT '' AS series, CAST(count(*) AS DOUBLE) AS value, CAST({END} AS BIGINT) AS time_ns FROM spans WHERE {_IN} AND name = 'view' HAVING count(*) > 0")(_run('sum by () ({name="view"})'))
query("count_observed", f"SELECT concat_ws(',', 'host.id=' || host, 'k=' || k, 'name=' || name, 'service.name=' || service_name, 'service_name=' || service_name, 'span.kind=' || kind, 'span_id=' || span_id, 'status.code=' || status, 'trace_id=' || trace_id) AS series, CAST(count(*) AS DOUBLE) AS value, CAST({END} AS BIGINT) AS time_ns FROM spans WHERE {_IN} AND name = 'error' GROUP BY ALL")(_run('count({name="error"})', mode="observed"))

_STEPS = f", steps AS (SELECT unnest(range({START}, {END} + 1, {STEP})) AS time_ns)"
_RATE = f"SELECT s.series, t.time_ns, round(count(*) / 18000.0::DOUBLE, 6) AS value FROM steps t JOIN spans s ON s.start_time >= t.time_ns - {BACK} AND s.start_time < t.time_ns WHERE %s GROUP BY ALL"
query("rate_basic", _RATE % "service_name = 'svc-1'", _STEPS)(_run('rate({service_name="svc-1"}[5h])'))
query("rate_multi_series", _RATE % "name IN ('click', 'error')", _STEPS)(_run('rate({name=~"click|error"}[5h])'))
_LATE = START + 12 * STEP
query("rate_observed", f"SELECT s.series, t.time_ns, round(count(*) / 18000.0::DOUBLE, 6) AS value FROM (SELECT unnest(range({_LATE}, {END} + 1, {STEP})) AS time_ns) t JOIN (SELECT * FROM spans WHERE end_time >= {_LATE} AND start_time <= {END}) s ON s.start_time >= t.time_ns - {BACK} AND s.start_time < t.time_ns WHERE service_name = 'svc-1' GROUP BY ALL")(
    lambda s, _: execute(s, '{service_name="svc-1"}[5h]'.join(("rate(", ")")), Options(_LATE, END, STEP, mode="observed"))[1]
)
query("rate_uneven_step", f"SELECT s.series, t.time_ns, round(count(*) / 18000.0::DOUBLE, 6) AS value FROM (SELECT unnest(range({START}, {END} + 1, {7 * STEP // 5})) AS time_ns) t JOIN spans s ON s.start_time >= t.time_ns - {BACK} AND s.start_time < t.time_ns WHERE name = 'view' GROUP BY ALL")(
    lambda s, _: execute(s, 'rate({name="view"}[5h])', Options(START, END, 7 * STEP // 5))[1]
)
_RATES = f"{_STEPS}, r AS (SELECT s.series, s.name, s.service_name, t.time_ns, round(count(*) / 18000.0::DOUBLE, 6) AS value FROM steps t JOIN spans s ON s.start_time >= t.time_ns - {BACK} AND s.start_time < t.time_ns GROUP BY ALL)"
query("sum_by_rate", "SELECT 'service_name=' || service_name AS series, time_ns, round(sum(value), 6) AS value FROM r GROUP BY ALL", _RATES)(_run("sum by (service_name) (rate({}[5h]))"))
query("max_rate", "SELECT '' AS series, time_ns, round(max(value), 6) AS value FROM r GROUP BY ALL", _RATES)(_run("max(rate({}[5h]))"))
query("avg_without_rate", "SELECT '__name__=' || name || ',service.name=' || service_name || ',service_name=' || service_name AS series, time_ns, round(avg(value), 6) AS value FROM r GROUP BY ALL", _RATES)(_run("avg without (k, host.id, span.kind, status.code) (rate({}[5h]))"))
_RANGE = "CASE WHEN n < 1000 THEN n || 'ns' WHEN n < 1000000 THEN (n // 1000) || 'µs' WHEN n < 1000000000 THEN (n // 1000000) || 'ms' ELSE (n // 1000000000) || 's' END"
_HEAT = f", h AS (SELECT bucket1s, duration_bucket, count(*) AS n FROM spans WHERE {_IN} GROUP BY ALL)"
query("sum_heatmap", "SELECT '' AS series, bucket1s AS time_ns, CAST(sum(n) AS DOUBLE) AS value FROM h GROUP BY bucket1s", _HEAT)(_run("sum(heatmap({}))"))
query("heatmap", f"SELECT bucket1s, duration_bucket, count(*) AS count FROM spans WHERE {_IN} GROUP BY ALL")(lambda s, _: series.heatmap(select(s, [], START, END)))
query("heatmap_matrix", f"SELECT 'duration_bucket=' || duration_bucket || ',duration_range=' || {_RANGE.replace('n ', '(1::BIGINT << duration_bucket) ')} || '-' || {_RANGE.replace('n ', '(1::BIGINT << (duration_bucket + 1)) ')} AS series, bucket1s AS time_ns, CAST(n AS DOUBLE) AS value FROM h", _HEAT)(_run("heatmap({})"))
_DAYS10 = 10 * 24 * STEP
_GRID = [START // _DAYS10 * _DAYS10 // scalar.SECOND + i * _DAYS10 // scalar.SECOND for i in range(4)]
query("heatmap_grid", "SELECT duration_bucket, " + ", ".join(f"count(*) FILTER (start_time // {_DAYS10} * {_DAYS10 // scalar.SECOND} = {t}) AS t{t}" for t in _GRID) + " FROM spans GROUP BY ALL")(
    lambda s, _: series.heatmap_grid(s, _DAYS10, [t * scalar.SECOND for t in _GRID])
)
for _p in (50, 95, 99):
    query(f"hq_p{_p}", f"""SELECT CAST(coalesce(CASE WHEN min(b) = 0 THEN 1 ELSE 3 * (1::BIGINT << (min(b) - 1)) END, 0) AS DOUBLE) AS value, CAST({END} AS BIGINT) AS time_ns
      FROM (SELECT CASE WHEN trunc(sum(n) OVER () * {_p / 100}) <= 0 THEN 0 WHEN sum(n) OVER (ORDER BY duration_bucket) >= trunc(sum(n) OVER () * {_p / 100}) THEN duration_bucket END AS b
            FROM (SELECT duration_bucket, count(*) AS n FROM spans WHERE {_IN} GROUP BY 1))""")(_run(f"histogram_quantile({_p / 100}, {{}})"))  # fmt: skip
query("count_over_time", f"SELECT series, {START} + (start_time - {START}) // {STEP} * {STEP} AS time_ns, CAST(count(*) AS DOUBLE) AS value FROM spans WHERE start_time >= {START} AND start_time < {END} GROUP BY ALL")(lambda s, _: series.with_series(series.count_over_time(s, START, END, STEP)))
query("rate_points", "SELECT series, string_agg(time_ns || ':' || CAST(n AS VARCHAR), ',' ORDER BY time_ns) AS points FROM (SELECT s.series, t.time_ns, count(*) AS n FROM steps t JOIN spans s ON s.start_time >= t.time_ns - 18000000000000 AND s.start_time < t.time_ns WHERE k = '5' GROUP BY ALL) GROUP BY series", _STEPS)(
    lambda s, _: series.nested(series.rate(select(s, [Matcher("k", "=", "5")]), START, END, STEP, BACK)).select("series", F.array_join(F.transform("points", lambda p: F.concat(p["time_ns"].cast("string"), F.lit(":"), F.round(p["value"] * 18000).cast("long").cast("string"))), ",").alias("points"))
)

# ---------------------------------------------------------------- exemplars

_EX = "SELECT bucket, rank, trace_id, span_id, duration FROM (SELECT *, CAST(row_number() OVER (PARTITION BY bucket ORDER BY duration {}, trace_id, span_id) AS INT) AS rank FROM {}) WHERE rank <= {}"
_BUCKETS = f"(SELECT *, {START} + (start_time - {START}) // {STEP} * {STEP} AS bucket FROM spans WHERE start_time >= {START} AND start_time < {END})"
_EXC = ("bucket", "rank", "trace_id", "span_id", "duration")
query("exemplars_slowest", _EX.format("DESC", _BUCKETS, 3))(lambda s, _: exemplars.by_step(s, START, END, STEP, 3).select(*_EXC))
query("exemplars_fastest", _EX.format("", _BUCKETS, 2))(lambda s, _: exemplars.by_step(s, START, END, STEP, 2, "fastest").select(*_EXC))
query("exemplars_lookback", _EX.format("DESC", f"(SELECT s.*, t.time_ns AS bucket FROM steps t JOIN spans s ON s.start_time >= t.time_ns - {BACK} AND s.start_time < t.time_ns)", 2), _STEPS)(lambda s, _: exemplars.with_lookback(s, START, END, STEP, BACK, 2).select(*_EXC))
query("exemplars_heatmap", f"SELECT bucket, duration_bucket, rank, span_id FROM (SELECT *, CAST(row_number() OVER (PARTITION BY bucket, duration_bucket ORDER BY duration DESC, trace_id, span_id) AS INT) AS rank FROM {_BUCKETS}) WHERE rank <= 1")(lambda s, _: exemplars.by_cell(s, START, END, STEP, 1).select("bucket", "duration_bucket", "rank", "span_id"))
query("exemplars_attached", f"SELECT c.series, c.bucket AS time_ns, c.value, x.span_id FROM (SELECT series, bucket, CAST(count(*) AS DOUBLE) AS value FROM {_BUCKETS} GROUP BY ALL) c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY series, bucket ORDER BY duration DESC, trace_id, span_id) AS r FROM {_BUCKETS}) x ON x.series = c.series AND x.bucket = c.bucket AND x.r = 1")(
    lambda s, _: series_text(exemplars.attached(series.count_over_time(s, START, END, STEP), exemplars.by_step(s, START, END, STEP, 1, by_series=True))).select("series", "time_ns", "value", F.col("exemplars")[0]["span_id"].alias("span_id"))
)


def series_text(d: DataFrame) -> DataFrame:
    return d.withColumn("series", F.array_join(F.transform("labels", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


# ---------------------------------------------------------------- traces

query("trace_search", "SELECT trace_id, count(*) AS n FROM spans WHERE name = 'error' AND trace_id IN (SELECT trace_id FROM spans WHERE name = 'error' GROUP BY 1 ORDER BY min(start_time) DESC, trace_id LIMIT 20) GROUP BY 1")(lambda s, _: traces.search(s, [Matcher("name", "=", "error")], limit=20).groupBy("trace_id").agg(F.count("*").alias("n")))
query("trace_summary", """SELECT trace_id, min(start_time) AS start_time, max(end_time) AS end_time, (max(end_time) - min(start_time)) // 1000000 AS duration_ms, count(*) AS span_count,
  CAST(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS error_count, count(DISTINCT service_name) AS service_count, arg_min(service_name, start_time) AS root_service, arg_min(name, (start_time, span_id)) AS root_name FROM spans GROUP BY trace_id""")(lambda s, _: traces.summary(s))  # fmt: skip
query("service_stats", "SELECT trace_id, service_name, count(*) AS span_count, CAST(count(status) AS BIGINT) AS error_count FROM spans GROUP BY ALL")(lambda s, _: traces.service_stats(s))
_ATTRS = "concat_ws(';', 'host.id=' || host, 'k=' || k, 'service.name=' || service_name, 'span.kind=' || kind, 'status.code=' || status)"
query("search_metadata", f"""SELECT trace_id AS id, arg_min(service_name, (start_time, span_id)) AS service, arg_min(name, (start_time, span_id)) AS root, CAST(min(start_time) AS VARCHAR) AS began, (max(end_time) - min(start_time)) // 1000000 AS ms, CAST(count(*) AS INT) AS matched,
  string_agg(span_id || ' ' || name || ' ' || start_time || ' ' || (end_time - start_time) || ' ' || {_ATTRS}, ',' ORDER BY start_time, span_id) AS spans, arg_min(service_name, start_time) || ':' || count(*) || ':' || count(status) AS stats FROM spans GROUP BY trace_id""")(
    lambda s, _: traces.search_metadata(s).select(
        F.col("traceID").alias("id"), F.col("rootServiceName").alias("service"), F.col("rootTraceName").alias("root"), F.col("startTimeUnixNano").alias("began"), F.col("durationMs").alias("ms"), F.col("spanSets")[0]["matched"].alias("matched"),
        F.array_join(F.transform(F.col("spanSets")[0]["spans"], lambda x: F.concat_ws(" ", x["spanID"], x["name"], x["startTimeUnixNano"], x["durationNanos"], F.array_join(F.transform(x["attributes"], lambda a: F.concat(a["key"], F.lit("="), a["value"]["stringValue"])), ";"))), ",").alias("spans"),
        F.array_join(F.transform(F.array_sort(F.map_entries("serviceStats")), lambda e: F.concat_ws(":", e["key"], e["value"]["spanCount"].cast("string"), e["value"]["errorCount"].cast("string"))), ";").alias("stats"),
    )
)
_TYPED = "concat_ws(';', 'k:' || CASE WHEN k IN ('0', '1') THEN 'bool' ELSE 'int64' END || ':' || k, 'span.kind:string:' || kind, 'status.code:string:' || status)"
_TAG_TEXT = lambda tags: F.array_join(F.transform(tags, lambda t: F.concat_ws(":", t["key"], t["type"], t["value"])), ";")
query("jaeger_spans", f"""SELECT trace_id, span_id, name AS operation, coalesce('CHILD_OF ' || trace_id || ' ' || parent_span_id, '') AS parent, start_time // 1000 AS start_us, duration // 1000 AS duration_us, 'p1' AS process, 0 AS logs,
  {_TYPED} AS tags, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY start_time, span_id) AS INT) AS seq FROM spans""")(
    lambda s, _: traces.document_spans(s).select(F.col("traceID").alias("trace_id"), F.col("spanID").alias("span_id"), F.col("operationName").alias("operation"), F.array_join(F.transform("references", lambda r: F.concat_ws(" ", r["refType"], r["traceID"], r["spanID"])), ";").alias("parent"), F.col("startTime").alias("start_us"), F.col("duration").alias("duration_us"), F.col("processID").alias("process"), F.size("logs").alias("logs"), _TAG_TEXT(F.col("tags")).alias("tags"), "seq")
)
query("jaeger_documents", f"""SELECT trace_id, string_agg(span_id || ' ' || name || ' ' || {_TYPED}, ',' ORDER BY start_time, span_id) AS spans,
  'p1:' || min(service_name) || ' ' || first(concat_ws(';', 'host.id:string:' || host, 'service.name:string:' || service_name) ORDER BY start_time, span_id) AS processes FROM spans GROUP BY 1""")(
    lambda s, _: traces.documents(s).select(
        F.col("traceID").alias("trace_id"), F.array_join(F.transform("spans", lambda x: F.concat_ws(" ", x["spanID"], x["operationName"], _TAG_TEXT(x["tags"]))), ",").alias("spans"),
        F.array_join(F.transform(F.array_sort(F.map_entries("processes")), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["serviceName"], F.lit(" "), _TAG_TEXT(e["value"]["tags"]))), ",").alias("processes"),
    )
)
query("otlp_resource_spans", f"""SELECT trace_id, service_name, first(concat_ws(';', 'host.id=' || host, 'service.name=' || service_name) ORDER BY start_time, span_id) AS resource,
  string_agg(span_id || ' ' || coalesce(parent_span_id, '') || ' ' || name || ' ' || CASE kind WHEN 'server' THEN 2 ELSE 3 END || ' ' || start_time || ' ' || end_time || ' ' || concat_ws(';', 'k=' || k, 'span.kind=' || kind, 'status.code=' || status), ',' ORDER BY start_time, span_id) AS spans FROM spans GROUP BY ALL""")(
    lambda s, _: traces.resource_spans(s).select(
        "trace_id", "service_name", _PAIRS(F.col("resource.attributes")).alias("resource"),
        F.array_join(F.transform(F.col("scopeSpans")[0]["spans"], lambda x: F.concat_ws(" ", x["spanId"], x["parentSpanId"], x["name"], x["kind"].cast("string"), x["startTimeUnixNano"], x["endTimeUnixNano"], _PAIRS(x["attributes"]))), ",").alias("spans"),
    )
)
_PAIRS = lambda attrs: F.array_join(F.transform(attrs, lambda a: F.concat(a["key"], F.lit("="), a["value"]["stringValue"])), ";")
query("trace_detail", f"{_SELECT} WHERE trace_id = {TRACE_SQL}")(lambda s, _: _plain(traces.detail(s, trace_of(s))))
query("typed_tags", "SELECT 'k' AS key, CASE WHEN k IN ('0', '1') THEN 'bool' ELSE 'int64' END AS type, count(*) AS n FROM spans WHERE k IS NOT NULL GROUP BY ALL UNION ALL SELECT 'span.kind', 'string', count(*) FROM spans UNION ALL SELECT 'status.code', 'string', count(status) FROM spans UNION ALL SELECT 'service.name', 'string', count(*) FROM spans UNION ALL SELECT 'host.id', 'string', count(host) FROM spans")(
    lambda s, _: lookups.attributes(s).groupBy("key", scalar.typed_tag_type(F.col("value")).alias("type")).agg(F.count("*").alias("n"))
)
query("resource_tags", "SELECT 'service.name' AS key, service_name AS value, count(*) AS n FROM spans GROUP BY ALL UNION ALL SELECT 'host.id', host, count(*) FROM spans WHERE host IS NOT NULL GROUP BY ALL")(
    lambda s, _: lookups.attributes(s).where(scalar.is_resource_attribute(F.col("key"))).groupBy("key", "value").agg(F.count("*").alias("n"))
)
query("root_spans", f"{_SELECT} WHERE parent_span_id IS NULL")(lambda s, _: _plain(traces.roots(s)))
query("orphans", f"{_SELECT} s WHERE name <> 'click' AND parent_span_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM spans p WHERE p.trace_id = s.trace_id AND p.span_id = s.parent_span_id AND p.name <> 'click')")(lambda s, _: _plain(traces.orphans(s.where("name <> 'click'"))))
query("trace_tree_depth", "SELECT trace_id, span_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY start_time, span_id) - 1 AS INT) AS depth, first_value(span_id) OVER (PARTITION BY trace_id ORDER BY start_time, span_id) AS root_span_id, CAST(1 AS INT) AS sibling FROM spans")(lambda s, _: traces.tree(s).select("trace_id", "span_id", "depth", "root_span_id", "sibling"))
query("trace_tree_flat", f"SELECT span_id, CAST(row_number() OVER (ORDER BY start_time, span_id) - 1 AS INT) AS depth FROM spans WHERE trace_id = {TRACE_SQL}")(lambda s, _: traces.flattened(s, trace_of(s)).select("span_id", "depth"))
query("self_join_parent", "SELECT c.span_id, p.name AS parent_name, c.start_time - p.start_time AS gap FROM spans c JOIN spans p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id")(
    lambda s, _: traces.with_parent(s).select("span_id", "parent_name", (F.col("start_time") - F.col("parent_start_time")).alias("gap"))
)

# ---------------------------------------------------------------- discovery

query("services", "SELECT DISTINCT service_name FROM spans")(lambda s, _: lookups.services(s, START, END))
query("operations", "SELECT DISTINCT name FROM spans WHERE service_name = 'svc-2'")(lambda s, _: lookups.operations(s, START, END, "svc-2"))
query("attribute_keys", "SELECT unnest(['k', 'span.kind', 'status.code', 'service.name', 'host.id']) AS key, false AS limited")(lambda s, _: lookups.attribute_keys(s, START, END))
query("attribute_values", "SELECT value, true AS limited FROM (SELECT DISTINCT host AS value FROM spans WHERE host IS NOT NULL ORDER BY 1 LIMIT 5)")(lambda s, _: lookups.attribute_values(s, "host.id", START, END, 5))
query("tag_names", "SELECT unnest(['k', 'span.kind', 'status.code', 'service.name', 'host.id']) AS key")(lambda s, _: lookups.tag_names(s, START, END))
query("tag_values", "SELECT DISTINCT kind AS value FROM spans")(lambda s, _: lookups.tag_values(s, "span.span.kind", START, END))
query("tag_name_forms", "SELECT unnest(['http.method', 'http.method', 'host.id', 'service.name']) AS tag")(lambda s, _: s.sparkSession.createDataFrame([(".http.method",), ("span.http.method",), ("resource.host.id",), ("service.name",)], "t string").select(scalar.normalized_tag_name(F.col("t")).alias("tag")))
query("index_stats", "SELECT count(*) AS total_spans, count(DISTINCT trace_id) AS total_traces, CAST(5 AS BIGINT) AS tag_keys, count(DISTINCT k) + count(DISTINCT host) + count(DISTINCT kind) + count(DISTINCT status) + count(DISTINCT service_name) AS tag_values FROM spans")(lambda s, _: lookups.stats(s))
query("wide_attributes", "SELECT span_id, k AS __attr_k, status AS \"__attr_status.code\" FROM spans")(lambda s, _: lookups.wide_attributes(s, ["k", "status.code"]))
query("merged_attributes", "SELECT span_id, concat_ws(',', 'extra=' || name, 'host.id=' || host, 'k=' || CASE WHEN name = 'view' THEN 'x' ELSE k END, 'service.name=' || service_name, 'span.kind=' || kind, 'status.code=' || status) AS tags FROM spans")(
    lambda s, _: lookups.with_attributes(s, s.select("span_id", F.lit("extra").alias("key"), F.col("name").alias("value")).union(s.where("name = 'view'").select("span_id", F.lit("k"), F.lit("x")))).select("span_id", labels.canonical(F.col("tags")).alias("tags"))
)

# ---------------------------------------------------------------- links

query("spans_with_links", "SELECT s.span_id, coalesce(l.linked_span_id, '') AS linked, CASE WHEN l.span_id IS NULL THEN 0 ELSE 1 END::INT AS n FROM spans s LEFT JOIN links l USING (span_id)")(lambda s, k: lookups.with_links(s, k).select("span_id", F.coalesce(F.get("links", F.lit(0))["linked_span_id"], F.lit("")).alias("linked"), F.size("links").alias("n")))
query("link_targets", "SELECT l.span_id, t.span_id AS linked_span_id, t.name AS target_name, t.service_name AS target_service FROM links l JOIN spans t ON t.trace_id = l.linked_trace_id AND t.span_id = l.linked_span_id")(lambda s, k: lookups.link_targets(s, k).select("span_id", "linked_span_id", "target_name", "target_service"))
query("trace_links", "SELECT l.span_id, linked_span_id FROM links l JOIN spans s USING (span_id) WHERE s.trace_id = (SELECT trace_id FROM spans WHERE span_id = (SELECT min(span_id) FROM links))")(lambda s, k: lookups.trace_links(s, k, trace_of(s, k.agg(F.min("span_id")).first()[0])).select("span_id", "linked_span_id"))
query("link_service_graph", "SELECT s.service_name AS source, t.service_name AS target, count(*) AS n FROM links l JOIN spans s USING (span_id) JOIN spans t ON t.span_id = l.linked_span_id AND t.trace_id = l.linked_trace_id GROUP BY ALL")(
    lambda s, k: lookups.link_targets(s, k).join(s.select("span_id", "service_name"), "span_id").groupBy(F.col("service_name").alias("source"), F.col("target_service").alias("target")).agg(F.count("*").alias("n"))
)

# ---------------------------------------------------------------- scalar functions

query("bucket_bounds", "SELECT CAST(b AS INT) AS b, CASE WHEN b < 0 THEN 0 WHEN b >= 62 THEN 4611686018427387904 ELSE 1::BIGINT << b END AS low, CASE WHEN b < 0 THEN 0 WHEN b >= 62 THEN 9223372036854775807 ELSE 1::BIGINT << (b + 1) END AS high FROM (SELECT unnest([-1, 0, 1, 10, 20, 26, 30, 61, 62, 63]) AS b)")(
    lambda s, _: s.sparkSession.createDataFrame([(b,) for b in (-1, 0, 1, 10, 20, 26, 30, 61, 62, 63)], "b int").select("b", scalar.bucket_low(F.col("b")).alias("low"), scalar.bucket_high(F.col("b")).alias("high"))
)
query("duration_ranges", f"SELECT duration_bucket AS b, {_RANGE.replace('n ', '(1::BIGINT << duration_bucket) ')} || '-' || {_RANGE.replace('n ', '(1::BIGINT << (duration_bucket + 1)) ')} AS r FROM (SELECT DISTINCT duration_bucket FROM spans)")(lambda s, _: s.select(F.col("duration_bucket").alias("b")).distinct().select("b", scalar.duration_range(F.col("b")).alias("r")))
query("id_forms", "SELECT event_id + 1 AS n, lpad(lower(to_hex(event_id + 1)), 16, '0') AS hex FROM events")(lambda s, _: s.select(scalar.id_number(F.col("span_id")).cast("long").alias("n"), scalar.hex_id(scalar.id_number(F.col("span_id")).cast("long")).alias("hex")))

# ---------------------------------------------------------------- SQL surface


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """The same text over the views ``spans`` and ``links`` and, where the dialects differ, another for the check."""

    def run(s: DataFrame, k: DataFrame) -> DataFrame:
        spansql.register(s, k)
        return spansql.query(s.sparkSession, text)[1]

    query(name, oracle or text)(run)


sql_query("sql_count", "SELECT count(*) AS n FROM spans")
sql_query("sql_group", "SELECT service_name, name, count(*) AS n, min(duration) AS low, max(duration) AS high FROM spans GROUP BY service_name, name HAVING count(*) > 10")
sql_query("sql_avg", "SELECT service_name, round(avg(duration), 3) AS mean FROM spans WHERE name LIKE '%e%' AND duration BETWEEN 1000000 AND 400000000 GROUP BY service_name")
sql_query("sql_analytics", "SELECT service_name, count(*) AS n, count(DISTINCT trace_id) AS traces, round(avg(duration) / 1000000, 3) AS mean_ms, sum(CASE WHEN name IN ('error', 'view') THEN 1 ELSE 0 END) AS odd FROM spans WHERE duration > 100000000 GROUP BY service_name", "SELECT service_name, count(*) AS n, count(DISTINCT trace_id) AS traces, round(avg(duration) / 1000000, 3) AS mean_ms, CAST(sum(CASE WHEN name IN ('error', 'view') THEN 1 ELSE 0 END) AS BIGINT) AS odd FROM spans WHERE duration > 100000000 GROUP BY service_name")
sql_query("sql_top", "SELECT span_id, duration FROM spans ORDER BY duration DESC, span_id LIMIT 5")
sql_query("sql_window", "SELECT span_id, CAST(rank() OVER (PARTITION BY service_name ORDER BY duration DESC) AS INT) AS r, duration - lag(duration) OVER (PARTITION BY trace_id ORDER BY start_time, span_id) AS d FROM spans")
sql_query("sql_rollup", "SELECT coalesce(service_name, '*') AS service, coalesce(name, '*') AS op, count(*) AS n FROM spans GROUP BY ROLLUP (service_name, name)")
sql_query("sql_cube", "SELECT coalesce(service_name, '*') AS service, coalesce(name, '*') AS op, count(*) AS n, CAST(grouping(name) AS INT) AS g FROM spans GROUP BY CUBE (service_name, name)")
sql_query("sql_setops", "(SELECT trace_id FROM spans WHERE name = 'click' INTERSECT SELECT trace_id FROM spans WHERE name = 'purchase') EXCEPT SELECT trace_id FROM spans WHERE name = 'error'")
sql_query("sql_union", "SELECT name AS x FROM spans UNION SELECT service_name FROM spans")
sql_query("sql_joins", "SELECT s.span_id, l.linked_span_id FROM spans s LEFT JOIN links l ON s.span_id = l.span_id WHERE s.name = 'purchase'")
sql_query("sql_full_join", "SELECT coalesce(a.trace_id, b.trace_id) AS trace_id, coalesce(a.n, 0) AS clicks, coalesce(b.n, 0) AS errors FROM (SELECT trace_id, count(*) AS n FROM spans WHERE name = 'click' GROUP BY trace_id) a FULL JOIN (SELECT trace_id, count(*) AS n FROM spans WHERE name = 'error' GROUP BY trace_id) b ON a.trace_id = b.trace_id")
sql_query("sql_exists", "SELECT count(*) AS n FROM spans s WHERE EXISTS (SELECT 1 FROM links l WHERE l.linked_span_id = s.span_id) AND s.service_name NOT IN (SELECT service_name FROM spans WHERE service_name > 'svc-3')")
sql_query("sql_filter_agg", "SELECT name, count(*) FILTER (WHERE duration > 50000000) AS slow, count(DISTINCT service_name) AS services FROM spans GROUP BY name")
sql_query("sql_cte", "SELECT service_name, max(n) AS most FROM (WITH c AS (SELECT service_name, trace_id, count(*) AS n FROM spans GROUP BY service_name, trace_id) SELECT * FROM c) GROUP BY service_name")
sql_query("sql_tags", "SELECT tags['host.id'] AS host, count(*) AS n FROM spans WHERE tags['status.code'] = 'error' GROUP BY tags['host.id']", "SELECT host, count(*) AS n FROM spans WHERE status = 'error' GROUP BY host")
sql_query("sql_strings", "SELECT DISTINCT upper(name) AS u, length(name) AS n, substr(name, 1, 2) AS p, concat(name, '!') AS c, replace(name, 'e', '3') AS r FROM spans", "SELECT DISTINCT upper(name) AS u, CAST(length(name) AS INT) AS n, substr(name, 1, 2) AS p, concat(name, '!') AS c, replace(name, 'e', '3') AS r FROM spans")
query("sql_asof", "SELECT e.span_id, c.span_id AS click_id FROM (SELECT * FROM spans WHERE name = 'error') e ASOF LEFT JOIN (SELECT * FROM spans WHERE name = 'click') c ON e.service_name = c.service_name AND e.start_time >= c.start_time")(
    lambda s, _: joins.asof(s.where("name = 'error'").select("service_name", "start_time", "span_id"), s.where("name = 'click'"), ["service_name"], "span_id", "click_id").select("span_id", "click_id")
)
query("sql_theta", "SELECT v.span_id, count(*) AS n FROM (SELECT * FROM spans WHERE name = 'view') v JOIN (SELECT * FROM spans WHERE name = 'click') c ON v.start_time BETWEEN c.start_time AND c.start_time + 5400000000000 GROUP BY ALL")(
    lambda s, _: joins.during(s.where("name = 'view'"), s.where("name = 'click'").withColumn("upto", F.col("start_time") + 5_400_000_000_000), end="upto").groupBy(F.col("p.span_id").alias("span_id")).agg(F.count("*").alias("n"))
)
sql_query("sql_lateral", "SELECT v.service_name, t.span_id FROM (SELECT DISTINCT service_name FROM spans) v, LATERAL (SELECT span_id FROM spans s WHERE s.service_name = v.service_name ORDER BY duration DESC, span_id LIMIT 2) t")
sql_query("sql_setops_all", "(SELECT name, service_name FROM spans UNION ALL SELECT name, service_name FROM spans WHERE duration > 100000000) EXCEPT ALL SELECT name, service_name FROM spans WHERE duration > 50000000")
sql_query("sql_intersect_all", "SELECT name, service_name FROM spans INTERSECT ALL SELECT name, service_name FROM spans WHERE duration > 50000000")


# ---------------------------------------------------------------- manifests

_BLOCKS = "(SELECT 'b' || lpad(CAST(us // 86400000000 - 19723 AS VARCHAR), 2, '0') AS block, min(us) * 1000 AS min_time, max(us) * 1000 AS max_time, count(*) AS span_count FROM ev GROUP BY us // 86400000000)"


def _manifest(s: DataFrame) -> DataFrame:
    day = F.call_function("div", F.col("start_time"), F.lit(86_400_000_000_000)) - 19723
    d = s.groupBy(day.alias("day")).agg(F.min("start_time").alias("min_time"), F.max("start_time").alias("max_time"), F.count("*").alias("span_count"))
    return d.select(F.concat(F.lit("b"), F.lpad(F.col("day").cast("string"), 2, "0")).alias("block"), "min_time", "max_time", "span_count", (F.col("day") % 3).cast("int").alias("level"), (F.col("day") * 86_400_000_000_000 + START).alias("created_at"), (F.col("day") * 10).alias("min_segment"), (F.col("day") * 10 + F.when(F.col("day") % 4 == 0, 7).otherwise(9)).alias("max_segment"))


query("block_overlap", f"SELECT block, span_count FROM {_BLOCKS} WHERE max_time >= {START + 30 * STEP} AND min_time <= {START + 80 * STEP}")(lambda s, _: store.overlapping(_manifest(s), START + 30 * STEP, START + 80 * STEP).select("block", "span_count"))
query("retention", f"SELECT block FROM {_BLOCKS} WHERE max_time < {START + 200 * STEP}")(lambda s, _: store.expired(_manifest(s), START + 200 * STEP).select("block"))
query("compaction_plan", f"SELECT CAST(d % 3 AS INT) AS level, string_agg(block, ',' ORDER BY block) AS blocks, CAST(sum(span_count) AS BIGINT) AS spans FROM (SELECT *, CAST(substr(block, 2) AS INT) AS d FROM {_BLOCKS}) GROUP BY 1 HAVING count(*) >= 2 AND {START + 3 * STEP} - (min(d) * 86400000000000 + {START}) >= CASE min(d) % 3 WHEN 0 THEN 600 WHEN 1 THEN 7200 ELSE 14400 END * 1000000000::BIGINT")(
    lambda s, _: store.compaction_plan(_manifest(s), START + 3 * STEP).select("level", F.array_join("blocks", ",").alias("blocks"), "spans")
)
query("wal_gap", f"SELECT d * 10 + 8 AS missing, lead(d) OVER (ORDER BY d) * 10 AS next FROM (SELECT CAST(substr(block, 2) AS BIGINT) AS d FROM {_BLOCKS}) QUALIFY d % 4 = 0 AND lead(d) OVER (ORDER BY d) IS NOT NULL")(lambda s, _: store.segment_gaps(_manifest(s)))

# ---------------------------------------------------------------- a second source of spans


def spans_from_orders(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders as root spans and their items as children."""
    root = orders.select("o_orderkey", scalar.hex_id(F.col("o_orderkey"), 32).alias("trace_id"), scalar.hex_id(F.col("o_orderkey")).alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.lit("order").alias("name"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("start_time"), F.concat(F.lit("order-"), "o_orderstatus").alias("service_name"))
    w = W.partitionBy("l_orderkey").orderBy(*items.columns)
    n = F.row_number().over(w)
    child = items.withColumn("n", n).select("l_orderkey", "n", "l_shipdate", "l_returnflag")
    child = child.select(F.col("l_orderkey").alias("o_orderkey"), scalar.hex_id(F.col("l_orderkey"), 32).alias("trace_id"), scalar.hex_id(F.col("l_orderkey") * 1000 + F.col("n") + (1 << 40)).alias("span_id"), scalar.hex_id(F.col("l_orderkey")).alias("parent_span_id"), F.lit("item").alias("name"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("start_time"), F.concat(F.lit("item-"), "l_returnflag").alias("service_name"))
    d = root.unionByName(child).drop("o_orderkey").withColumn("duration", F.lit(1_000_000).cast("long"))
    return with_generated(d.withColumn("end_time", F.col("start_time") + F.col("duration")).withColumn("tags", F.create_map(F.lit("name"), F.col("name"))))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spans_from_orders(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem")))
    return d.groupBy("service_name", "name").agg(F.count("*").alias("n"), F.countDistinct("trace_id").alias("traces"), F.min("start_time").alias("first"))


_QUERIES["order_spans"] = _orders
_SQL["order_spans"] = """
SELECT 'order-' || o_orderstatus AS service_name, 'order' AS name, count(*) AS n, count(DISTINCT o_orderkey) AS traces, min(epoch_us(o_orderdate)) * 1000 AS first FROM orders GROUP BY 1
UNION ALL SELECT 'item-' || l_returnflag, 'item', count(*), count(DISTINCT l_orderkey), min(epoch_us(l_shipdate)) * 1000 FROM lineitem GROUP BY 1"""


def queries() -> dict[str, Query]:
    from . import queries_surface  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import queries_surface  # noqa: F401

    return dict(_SQL)

