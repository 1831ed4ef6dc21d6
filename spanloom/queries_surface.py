"""Further registered queries: traces of several services, stores, streams as batches, texts of the language and its scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, to_prometheus
from .functions import scalar
from .functions.labels import canonical
from .operators import exemplars, lookups, series, traces
from .operators.matchers import Matcher, select
from .plans import language
from .plans.planner import Options, execute
from .queries import _COLS, _CTE, _QUERIES, _SELECT, _SQL, END, START, STEP, TRACE_SQL, Query, _plain, query, spans_from_orders, trace_of
from .shared import new_path
from .sources import otlp
from .streaming import windows
from .streaming.store import SpanStore

# ---------------------------------------------------------------- traces of several services, which branch

_ORDERS = """
os AS (
  SELECT o_orderkey AS n, lpad(lower(to_hex(o_orderkey)), 32, '0') AS trace_id, lpad(lower(to_hex(o_orderkey)), 16, '0') AS span_id, NULL AS parent_span_id, 'order' AS name, epoch_us(o_orderdate) * 1000 AS start_time, 'order-' || o_orderstatus AS service_name FROM orders
  UNION ALL
  SELECT l_orderkey, lpad(lower(to_hex(l_orderkey)), 32, '0'), lpad(lower(to_hex(l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) + 1099511627776)), 16, '0'),
    lpad(lower(to_hex(l_orderkey)), 16, '0'), 'item', epoch_us(l_shipdate) * 1000, 'item-' || l_returnflag FROM lineitem)
"""


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_from_orders(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem")))


def orders_query(name: str, sql: str):
    def register(f):
        _QUERIES[name] = lambda spark, sf_dir: f(order_spans(spark, sf_dir))
        _SQL[name] = f"WITH {_ORDERS} {sql}"
        return f

    return register


orders_query("order_documents", """, p AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY start_time, span_id) AS seq, min(lpad(CAST(start_time AS VARCHAR), 20, '0') || span_id) OVER (PARTITION BY trace_id, service_name) AS first_of FROM os)
  SELECT trace_id, span_id, CAST(seq AS INT) AS seq, 'p' || dense_rank() OVER (PARTITION BY trace_id ORDER BY first_of) AS process, service_name AS service FROM p""")(
    lambda s: traces.documents(s).select("traceID", "processes", F.posexplode("spans").alias("at", "x")).select(F.col("traceID").alias("trace_id"), F.col("x.spanID").alias("span_id"), (F.col("at") + 1).alias("seq"), F.col("x.processID").alias("process"), F.col("processes")[F.col("x.processID")]["serviceName"].alias("service"))
)
orders_query("order_tree", "SELECT trace_id, span_id, CASE WHEN parent_span_id IS NULL THEN 0 ELSE 1 END AS depth, lpad(lower(to_hex(n)), 16, '0') AS root_span_id, CAST(row_number() OVER (PARTITION BY trace_id, parent_span_id ORDER BY start_time, span_id) AS INT) AS sibling FROM os")(
    lambda s: traces.tree(s).select("trace_id", "span_id", "depth", "root_span_id", "sibling")
)
orders_query("order_summary", "SELECT trace_id, count(*) AS span_count, count(DISTINCT service_name) AS service_count, max(CASE WHEN parent_span_id IS NULL THEN service_name END) AS root_service FROM os GROUP BY 1")(lambda s: traces.summary(s).select("trace_id", "span_count", "service_count", "root_service"))
orders_query("order_service_stats", "SELECT trace_id, string_agg(service_name || ':' || n, ',' ORDER BY service_name) AS stats FROM (SELECT trace_id, service_name, count(*) AS n FROM os GROUP BY ALL) GROUP BY 1")(
    lambda s: traces.search_metadata(s).select(F.col("traceID").alias("trace_id"), F.array_join(F.transform(F.array_sort(F.map_entries("serviceStats")), lambda e: F.concat_ws(":", e["key"], e["value"]["spanCount"].cast("string"))), ",").alias("stats"))
)
orders_query("order_tree_flat", "SELECT span_id, CAST(CASE WHEN parent_span_id IS NULL THEN 0 ELSE 1 END AS INT) AS depth, CAST(row_number() OVER (ORDER BY parent_span_id IS NOT NULL, start_time, span_id) AS INT) AS place FROM os WHERE n = (SELECT min(o_orderkey) FROM orders)")(
    lambda s: traces.flattened(s, s.agg(F.min("trace_id")).first()[0]).select("span_id", "depth", (F.when(F.size("path") == 1, 1).otherwise(1 + F.element_at("path", -1))).cast("int").alias("place"))
)
orders_query("order_ancestors", "SELECT parent_span_id AS ancestor FROM os WHERE span_id = (SELECT max(span_id) FROM os WHERE n = (SELECT min(o_orderkey) FROM orders))")(lambda s: _ancestors(s))


def _ancestors(s: DataFrame) -> DataFrame:
    trace = s.agg(F.min("trace_id")).first()[0]
    span = lookups.by_trace_id(s, trace).agg(F.max("span_id")).first()[0]
    return s.sparkSession.createDataFrame([(x,) for x in traces.ancestors(s, trace, span)], "ancestor string")


# ---------------------------------------------------------------- OTLP

_LATER = "parent_span_id = '0000000000000001'"
query("otlp_round_trip", """SELECT trace_id, span_id, parent_span_id, name, start_time, end_time, duration, service_name, concat_ws(',', 'host.id=' || first_value(host) OVER (PARTITION BY trace_id, service_name ORDER BY start_time, span_id), 'k=' || k, 'name=' || name, 'parent_span_id=' || parent_span_id,
  'scope.name=spanloom', 'scope.version=1.0.0', 'service.name=' || service_name, 'span.kind=' || kind, 'status.code=unset') AS tags FROM spans""")(
    lambda s, _: otlp.spans(traces.export_requests(s)).select(*_COLS, canonical(F.col("tags")).alias("tags"))
)
query("otlp_links", "SELECT span_id, linked_trace_id, linked_span_id, 'reason=last-click' AS attributes FROM links")(
    lambda s, k: otlp.links(traces.export_requests(lookups.with_links(s, k))).select("span_id", "linked_trace_id", "linked_span_id", canonical(F.col("attributes")).alias("attributes"))
)

# ---------------------------------------------------------------- stores

_SECOND = "name IN ('error', 'purchase')"


def _store(s: DataFrame, k: DataFrame | None = None) -> SpanStore:
    """A store of two blocks that share the errors; the second holds all links."""
    store = SpanStore(s.sparkSession, new_path(s.sparkSession, "store"))
    store.append(s.where("name <> 'purchase'"), segment=1)
    store.append(s.where(_SECOND), segment=2, links=k)
    return store


_IN_WINDOW = f"end_time >= {START + 30 * STEP} AND start_time <= {START + 80 * STEP}"
query("store_read", f"{_SELECT} WHERE {_IN_WINDOW} UNION ALL {_SELECT} WHERE {_IN_WINDOW} AND name = 'error'")(lambda s, _: _plain(_store(s).read(START + 30 * STEP, START + 80 * STEP)))
query("store_snapshot", f"{_SELECT} WHERE name <> 'purchase'")(lambda s, _: _plain(_store(s).read(snapshot=1)))
query("store_links", "SELECT s.span_id, l.linked_span_id FROM spans s LEFT JOIN links l USING (span_id) WHERE s.name = 'purchase'")(
    lambda s, k: Engine.from_store(_store(s, k)).select([Matcher("name", "=", "purchase")], include_links=True).select("span_id", F.get("links", F.lit(0))["linked_span_id"].alias("linked_span_id"))
)
query("store_attributes", "SELECT span_id, unnest([k, kind]) AS value FROM spans WHERE name = 'purchase'")(lambda s, _: _store(s).read_attributes(snapshot=2).join(s.where("name = 'purchase'").select("span_id"), "span_id", "left_semi").where("key IN ('k', 'span.kind')").select("span_id", "value"))
query("store_by_attribute", f"{_SELECT} WHERE host = 'h12' AND name <> 'purchase'")(lambda s, _: _plain(_store(s).by_attribute("host.id", "h12", snapshot=1)))


def _compacted(s: DataFrame, k: DataFrame) -> SpanStore:
    store = _store(s, k)
    store.compact(now_ns=1 << 62)
    return store


query("store_compacted", _SELECT)(lambda s, k: _plain(_compacted(s, k).read()))
query("store_compacted_links", "SELECT span_id, linked_span_id FROM links")(lambda s, k: _compacted(s, k).read_links().select("span_id", "linked_span_id"))
query("store_stats", "SELECT CAST(0 AS INT) AS level, CAST(2 AS BIGINT) AS blocks, count(*) + count(*) FILTER (name = 'error') AS spans, min(start_time) AS min_time, max(end_time) AS max_time FROM spans")(lambda s, _: _store(s).stats())
query("store_described", f"SELECT 'level 0, ' || count(*) || ' spans, ' || strftime(make_timestamp(min(start_time) // 1000), '%Y-%m-%dT%H:%M:%SZ') || ' to ' || strftime(make_timestamp(max(end_time) // 1000), '%Y-%m-%dT%H:%M:%SZ') AS text FROM spans WHERE {_SECOND} UNION ALL SELECT 'level 0, ' || count(*) || ' spans, ' || strftime(make_timestamp(min(start_time) // 1000), '%Y-%m-%dT%H:%M:%SZ') || ' to ' || strftime(make_timestamp(max(end_time) // 1000), '%Y-%m-%dT%H:%M:%SZ') FROM spans WHERE name <> 'purchase'")(
    lambda s, _: _store(s).described().select(F.regexp_extract("text", "level.*", 0).alias("text"))
)


def _headed(s: DataFrame, k: DataFrame | None = None) -> SpanStore:
    """One block of two segments that are deleted, and two segments in the head."""
    store = SpanStore(s.sparkSession, new_path(s.sparkSession, "store"))
    store.write_head(s.where("name = 'click'"))
    store.write_head(s.where("name = 'view'"))
    store.flush(force=True)
    store.checkpoint(threshold=1)
    store.write_head(s.where("name IN ('error', 'signup')"))
    store.write_head(s.where("name = 'purchase'"), k)
    return store


query("head_scan", f"{_SELECT} WHERE name IN ('error', 'signup')")(lambda s, _: _plain(_headed(s).head(upto=3)))
query("head_and_blocks", f"{_SELECT} WHERE service_name = 'svc-2'")(lambda s, k: _plain(select(Engine.from_store(_headed(s, k), include_head=True).spans, [Matcher("service_name", "=", "svc-2")])))
query("head_links", "SELECT span_id, linked_span_id FROM links")(lambda s, k: _headed(s, k).read_links(include_head=True).select("span_id", "linked_span_id"))
query("head_replay", "SELECT unnest([3, 4])::BIGINT AS segment, unnest([(SELECT count(*) FROM spans WHERE name IN ('error', 'signup')), (SELECT count(*) FROM spans WHERE name = 'purchase')]) AS span_count")(lambda s, _: _headed(s).replay().select("segment", "span_count"))


def _ingested(s: DataFrame) -> DataFrame:
    """Files of spans as a stream, ingested twice from one checkpoint."""
    spark, path = s.sparkSession, new_path(s.sparkSession, "stream")
    own = s.drop("bucket1s", "duration_bucket")
    own.repartition(3).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    store = SpanStore(spark, f"{path}/store")
    for _ in range(2):
        store.ingest(stream, f"{path}/checkpoint").awaitTermination()
    return store.read()


query("store_ingest", _SELECT)(lambda s, _: _plain(_ingested(s)))
query("query_stats", f"SELECT 'spans_scanned' AS what, count(*) AS n FROM spans WHERE service_name = 'svc-1' AND end_time >= {START} AND start_time <= {END} AND name <> 'purchase' UNION ALL SELECT 'blocks_scanned', 1")(lambda s, _: _query_stats(s))


def _query_stats(s: DataFrame) -> DataFrame:
    store = SpanStore(s.sparkSession, new_path(s.sparkSession, "store"))
    store.append(s.where("name <> 'purchase'"))
    store.append(s.where("name = 'purchase'").selectExpr("* EXCEPT (start_time, end_time)", f"start_time + {2 * (END - START)} AS start_time", f"end_time + {2 * (END - START)} AS end_time"))
    _, _, stats = Engine.from_store(store, START, END).query_with_stats('count by (name) ({service_name="svc-1"})', START, END)
    return s.sparkSession.createDataFrame([(k, stats[k]) for k in ("spans_scanned", "blocks_scanned")], "what string, n long")


# ---------------------------------------------------------------- continuous forms, run as batches

query("window_rate", f"SELECT service_name, name, (start_time // {STEP} + w.i + 1) * {STEP} AS time_ns, round(count(*) / 7200.0::DOUBLE, 6) AS value FROM spans, (SELECT unnest([0, 1]) AS i) w GROUP BY ALL")(lambda s, _: windows.rate(s, "2 hours", "1 hour", 7200.0))
query("window_heatmap", f"SELECT start_time // {STEP} * {STEP} AS time_ns, duration_bucket, count(*) AS count FROM spans GROUP BY ALL")(lambda s, _: windows.heatmap(s, "1 hour"))
query("window_sessions", """SELECT service_name, min(start_time) // 1000 * 1000 AS start_ns, max(start_time) // 1000 * 1000 + 600000000000 AS end_ns, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY service_name ORDER BY start_time, span_id) AS session FROM (
    SELECT *, CASE WHEN start_time - lag(start_time) OVER (PARTITION BY service_name ORDER BY start_time, span_id) <= 600000000000 THEN 0 ELSE 1 END AS fresh FROM spans)) GROUP BY service_name, session""")(lambda s, _: windows.sessions(s, "10 minutes"))  # fmt: skip

# ---------------------------------------------------------------- the engine's surface

query("engine_limit", f"{_SELECT} WHERE end_time >= {START} AND start_time <= {END} AND name = 'view' ORDER BY start_time, span_id LIMIT 7")(lambda s, _: _plain(execute(s, '{name="view"}', Options(START, END, limit=7))[1]))
query("group_alias", f"SELECT 'name=' || name AS series, CAST(count(*) AS DOUBLE) AS value, CAST({END} AS BIGINT) AS time_ns FROM spans WHERE start_time <= {END} AND end_time >= {START} GROUP BY name")(lambda s, _: execute(s, "sum group (name) ({})", Options(START, END, STEP))[1])
query("vector", f"SELECT series, 1.0::DOUBLE AS value, CAST({END} AS BIGINT) AS time_ns FROM spans WHERE name = 'error'")(lambda s, _: series.vector(select(s, [Matcher("name", "=", "error")]), END))
query("present_keys", "SELECT unnest(['host.id', 'k', 'service.name', 'span.kind', 'status.code']) AS key")(lambda s, _: lookups.present_keys(s))
query("search_by_tags", "SELECT trace_id FROM spans WHERE kind = 'server' AND service_name = 'svc-1' AND name = 'view' AND duration BETWEEN 1000000 AND 400000000 GROUP BY 1 ORDER BY min(start_time) DESC, trace_id LIMIT 20")(
    lambda s, _: Engine(s).search_traces("svc-1", "view", {"span.kind": "server"}, min_duration=1_000_000, max_duration=400_000_000).select(F.col("traceID").alias("trace_id"))
)
query("exemplar_caps", f"SELECT bucket, count(*) AS n FROM (SELECT {START} + (start_time - {START}) // {100 * STEP} * {100 * STEP} AS bucket, row_number() OVER (PARTITION BY (start_time - {START}) // {100 * STEP} ORDER BY duration DESC) AS r FROM spans) WHERE r <= 100 GROUP BY 1")(
    lambda s, _: exemplars.by_step(s, START, END, 100 * STEP, 5000).groupBy("bucket").agg(F.count("*").alias("n"))
)
query("prometheus_values", f"SELECT 'name=' || name AS metric, CAST(count(*) AS VARCHAR) AS value FROM spans WHERE start_time <= {END} AND end_time >= {START} GROUP BY name")(lambda s, _: _prometheus(s))


def _prometheus(s: DataFrame) -> DataFrame:
    kind, plan = execute(s, "count by (name) ({})", Options(START, END, STEP))
    rows = [(",".join(f"{k}={v}" for k, v in r["metric"].items()), r["value"][1]) for r in to_prometheus(kind, plan)["result"]]
    return s.sparkSession.createDataFrame(rows, "metric string, value string")


# ---------------------------------------------------------------- texts and scalars


def fixed(name: str, schema: str, make, sql: str) -> None:
    """Rows that do not depend on the data: made by the library, and written out in SQL."""
    query(name, f"SELECT * FROM (VALUES {sql}) t({', '.join(c.split()[0] for c in schema.split(','))})")(lambda s, _: s.sparkSession.createDataFrame(make(), schema) if callable(make) else make)


def _forms() -> list[tuple]:
    out = []
    for text in ('prometheus{b="x",a!="y"}[5m]', "sum group (z,a) (rate({}[1h30m]))", "histogram_quantile(0.95, {})", "heatmap(api{})", "sum(heatmap({}))", "rate({})", "histogram_quantile({}, {})", "count without (pod) ({})", "0.5", '{a="\\u00e9\\x41\\t"}', "sum by (rate) ({})", '{a="\\q"}', "x # note", "heatmap(rate({}[5m]))"):
        try:
            node = language.parse(text)
        except language.LanguageError:
            out.append((text, "refused", "", "", ""))
            continue
        plain = language.normalize(node)
        seen: list[str] = []
        language.walk(node, lambda n: seen.append(type(n).__name__[0]))
        try:
            language.validate(node)
            kind = language.result_type(node)
        except language.LanguageError:
            kind = "invalid"
        found, length, heat = language.bare_selector(node)
        again = language.parse(node.pretty()) == node and language.parse(str(plain)) == plain
        out.append((text, kind, str(plain) if again else "not read back", "".join(seen), f"{found}|{length}|{heat}"))
    return out


fixed("language_forms", "text string, kind string, printed string, nodes string, selector string", _forms, r"""
  ('prometheus{b="x",a!="y"}[5m]', 'spans', 'prometheus{a!="y",b="x"}[5m]', 'RS', 'prometheus{b="x",a!="y"}|5m|False'),
  ('sum group (z,a) (rate({}[1h30m]))', 'matrix', 'sum by (a,z) (rate({}[1h30m]))', 'ACRS', '{}|1h30m|False'),
  ('histogram_quantile(0.95, {})', 'scalar', 'histogram_quantile(0.95, {})', 'CNS', '{}|None|False'),
  ('heatmap(api{})', 'matrix', 'heatmap(api{})', 'CS', 'api{}|None|True'),
  ('sum(heatmap({}))', 'matrix', 'sum (heatmap({}))', 'ACS', '{}|None|True'),
  ('rate({})', 'invalid', 'rate({})', 'CS', '{}|None|False'),
  ('histogram_quantile({}, {})', 'invalid', 'histogram_quantile({}, {})', 'CSS', '{}|None|False'),
  ('count without (pod) ({})', 'vector', 'count without (pod) ({})', 'AS', '{}|None|False'),
  ('0.5', 'scalar', '0.5', 'N', 'None|None|False'),
  ('{a="\u00e9\x41\t"}', 'spans', '{a="éA' || chr(9) || '"}', 'S', '{a="éA' || chr(9) || '"}|None|False'),
  ('sum by (rate) ({})', 'refused', '', '', ''),
  ('{a="\q"}', 'refused', '', '', ''),
  ('x # note', 'spans', 'x{}', 'S', 'x{}|None|False'),
  ('heatmap(rate({}[5m]))', 'refused', '', '', '')""")

_S = scalar.SECOND
fixed("edge_scalars", "what string, value long", lambda: [
    *((f"duration {t}", scalar.parse_duration(t)) for t in ("5m", "1h30m", "1d12h", "2w", "1y")),
    *((f"time {t}", scalar.parse_time(t)) for t in ("1700000000", "1700000000000000000", "2023-11-14T22:13:20Z", "2023-11-14T23:13:20.5+01:00")),
    *((f"step {m}", scalar.default_step(m * 60 * _S)) for m in (5, 6, 30, 31, 120, 360, 1440, 10080, 10081)),
    *((f"rate step {a} {b}", scalar.default_rate_step(a * _S, b * _S)) for a, b in ((60, 300), (1800, 300), (36000, 300), (100, 8))),
    *((f"exemplars {n} {h}", exemplars.fetch_limit(n, h)) for n, h in ((1, False), (3, False), (100, False), (1, True), (5, True))),
], """
  ('duration 5m', 300000000000), ('duration 1h30m', 5400000000000), ('duration 1d12h', 129600000000000), ('duration 2w', 1209600000000000), ('duration 1y', 31536000000000000),
  ('time 1700000000', 1700000000000000000), ('time 1700000000000000000', 1700000000000000000), ('time 2023-11-14T22:13:20Z', 1700000000000000000), ('time 2023-11-14T23:13:20.5+01:00', 1700000000500000000),
  ('step 5', 5000000000), ('step 6', 15000000000), ('step 30', 15000000000), ('step 31', 30000000000), ('step 120', 30000000000), ('step 360', 60000000000), ('step 1440', 300000000000), ('step 10080', 900000000000), ('step 10081', 3600000000000),
  ('rate step 60 300', 15000000000), ('rate step 1800 300', 75000000000), ('rate step 36000 300', 75000000000), ('rate step 100 8', 2000000000),
  ('exemplars 1 False', 50), ('exemplars 3 False', 90), ('exemplars 100 False', 1000), ('exemplars 1 True', 300), ('exemplars 5 True', 1000)""")  # fmt: skip

query("human_durations", "SELECT span_id, CASE WHEN duration < 1000 THEN duration || 'ns' WHEN duration < 1000000 THEN printf('%.2f', duration / 1000.0) || 'µs' WHEN duration < 1000000000 THEN printf('%.2f', duration / 1000000.0) || 'ms' ELSE printf('%.2f', duration / 1000000000.0) || 's' END AS text FROM spans")(
    lambda s, _: s.select("span_id", scalar.human_duration(F.col("duration")).alias("text"))
)


def _codes(s: DataFrame) -> DataFrame:
    d = s.sparkSession.createDataFrame([(x,) for x in ("0", "1", "2", "3", "5", "9", "SPAN_KIND_SERVER", "STATUS_CODE_ERROR", None)], "code string")
    return d.select("code", scalar.span_kind(F.col("code")).alias("kind"), scalar.status_code(F.col("code")).alias("status"))


query("kind_and_status", """SELECT * FROM (VALUES ('0', 'unspecified', 'unset'), ('1', 'internal', 'ok'), ('2', 'server', 'error'), ('3', 'client', 'unknown'), ('5', 'consumer', 'unknown'), ('9', 'unspecified', 'unknown'), ('SPAN_KIND_SERVER', 'server', 'unknown'),
  ('STATUS_CODE_ERROR', 'unspecified', 'error'), (NULL, 'unspecified', 'unset')) t(code, kind, status)""")(lambda s, _: _codes(s))  # fmt: skip


def _any_values(s: DataFrame) -> DataFrame:
    texts = ['{"stringValue":"x"}', '{"boolValue":true}', '{"intValue":"-7"}', '{"doubleValue":1.5}', '{"arrayValue":{"values":["a"]}}', '{"kvlistValue":{"values":[]}}', '{"bytesValue":"AQID"}', "{}"]
    d = s.sparkSession.createDataFrame([(t,) for t in texts], "t string")
    return d.select("t", scalar.attribute_text(F.from_json("t", otlp._ANY)).alias("text"))


query("any_values", """SELECT * FROM (VALUES ('{"stringValue":"x"}', 'x'), ('{"boolValue":true}', 'true'), ('{"intValue":"-7"}', '-7'), ('{"doubleValue":1.5}', '1.500000'), ('{"arrayValue":{"values":["a"]}}', '[array]'),
  ('{"kvlistValue":{"values":[]}}', '[map]'), ('{"bytesValue":"AQID"}', '[3 bytes]'), ('{}', '')) t(t, text)""")(lambda s, _: _any_values(s))  # fmt: skip

__all__ = ["Query", "TRACE_SQL", "trace_of", "_CTE"]
