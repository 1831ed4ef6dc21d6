import json

import pytest
from helpers import MIN, MS, S, spans
from pyspark.sql import functions as F

from spanloom.engine import Engine, to_json
from spanloom.functions import scalar
from spanloom.operators import exemplars, lookups, series, traces
from spanloom.operators.matchers import Matcher, every, select
from spanloom.plans.planner import Options, execute
from spanloom.sources import otlp
from spanloom.streaming import store, windows

T = 1_700_000_000 * S - 1_700_000_000 * S % MIN


def test_matchers(spark):
    d = spans(spark, [
        {"span_id": "1", "start_time": T, "name": "GET /api/users", "service_name": "api", "tags": {"env": "prod", "v": "1.0"}},
        {"span_id": "2", "start_time": T, "name": "POST /api/users", "service_name": "api", "tags": {"env": "prod", "v": "2.0"}},
        {"span_id": "3", "start_time": T, "name": "", "service_name": "order", "tags": {"env": "dev\n"}},
    ])

    def ids(*ms):
        return sorted(int(r.span_id, 16) for r in d.where(every(Matcher(*m) for m in ms)).collect())

    assert ids(("env", "=", "prod")) == [1, 2]
    assert ids(("env", "=", "prod"), ("v", "=", "2.0")) == [2]
    assert ids(("v", "!=", "1.0")) == [2, 3] and ids(("v", "!~", "[12].*")) == [3]
    assert ids(("env", "=~", "pro")) == [] and ids(("env", "=~", "pro.")) == [1, 2]
    assert ids(("env", "=~", "dev")) == []  # anchored at the very end
    assert ids(("missing", "=", "")) == [] and ids(("name", "!=", "")) == [1, 2, 3] and ids(("name", "=~", ".*")) == [1, 2]
    assert ids(("service.name", "=", "order")) == ids(("service_name", "=", "order")) == [3] and ids() == [1, 2, 3]


def test_overlap_and_pushdown(spark):
    d = spans(spark, [{"span_id": str(i + 1), "start_time": T - m * MIN, "duration": MS} for i, m in enumerate((120, 5, 1))])
    assert select(d, [], T - 10 * MIN, T).count() == 2
    assert select(d, [], T - 5 * MIN + MS, T - 5 * MIN + MS).count() == 1  # both ends included


def test_bucket_boundaries(spark):
    at = [0, MIN, 2 * MIN, 3 * MIN, MIN - 1, 1]
    d = spans(spark, [{"span_id": str(i + 1), "start_time": T + x} for i, x in enumerate(at)])
    got = {(r.time_ns - T) // MIN: r.value for r in series.count_over_time(d, T, T + 3 * MIN, MIN).collect()}
    assert got == {0: 3, 1: 1, 2: 1}
    got = {(r.time_ns - T) // MIN: r.value * 60 for r in series.rate(d, T, T + 3 * MIN, MIN, MIN).collect()}
    assert {k: round(v) for k, v in got.items()} == {1: 3, 2: 1, 3: 1}


def test_rate_of_two_series(spark):
    rows = [{"span_id": f"{i:x}", "start_time": T + i * 6 * S, "name": "exec", "service_name": "a", "tags": {"op": "x"}} for i in range(1, 301)]
    rows += [{"span_id": f"{1000 + i:x}", "start_time": T + i * 3 * S, "name": "http", "service_name": "b"} for i in range(1, 601)]
    d = spans(spark, rows)
    kind, r = execute(d, "rate({}[5m])", Options(T, T + 30 * MIN, MIN))
    full = r.where((F.col("time_ns") > T + 5 * MIN) & (F.col("time_ns") <= T + 30 * MIN)).groupBy("series").agg(F.min("value").alias("a"), F.max("value").alias("b"), F.count("*").alias("n")).collect()
    assert kind == "matrix" and {(x.a, x.b, x.n) for x in full} == {(0.166667, 0.166667, 25), (0.333333, 0.333333, 25)}
    total = series.rate(d, T, T + 30 * MIN, 5 * MIN, 5 * MIN).agg(F.sum("value")).first()[0]  # windows that do not overlap count all but the last span
    assert round(total * 300) == 898
    with pytest.raises(ValueError):
        series.rate(d, T, T, 0, 0)


def test_partitioning_does_not_matter(spark, sf):
    from spanloom.queries import END, START, STEP, tables

    s, _ = tables(spark, sf)
    a = series.with_series(series.rate(s.repartition(1), START, END, STEP, 5 * STEP))
    b = series.with_series(series.rate(s.repartition(7), START, END, STEP, 5 * STEP))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert series.heatmap(s).agg(F.sum("count")).first()[0] == s.count()


def test_aggregations_and_quantile(spark):
    d = spans(spark, [{"span_id": str(i), "start_time": T, "duration": x * MS, "tags": {"h": "a"} if i % 2 else {}} for i, x in enumerate((1, 2, 3, 100), 1)])
    run = lambda text, **k: execute(d, text, Options(T, T + MIN, **k))[1].orderBy("value" if "quantile" in text else "series").collect()
    assert [(r.series, r.value) for r in run("count by (h) ({})")] == [("", 2), ("h=a", 2)]
    assert [r.value for r in run("max({})")] == [100 * MS] and [r.value for r in run("avg({})")] == [1]
    assert len(run("count({})", mode="observed")) == 4 and run('count({h="none"})') == []
    assert [r.value for r in run("histogram_quantile(0.5, {})")] == [1.5 * 2**20]
    assert [r.value for r in run("histogram_quantile(0.1, {})")] == [1] and [r.value for r in run('histogram_quantile(0.5, {h="none"})')] == [0]
    with pytest.raises(ValueError):
        run("histogram_quantile(1.5, {})")
    with pytest.raises(ValueError):
        run("histogram_quantile(0.5, rate({}[5m]))")
    assert [r.value for r in run("sum(count by (h) ({}))")] == [4]


def test_scalars(spark):
    vals = [-5, 0, 1, 2, 3, 1023, 1024, 2**62, 2**63 - 1]
    got = [r.b for r in spark.createDataFrame([(v,) for v in vals], "v long").select(scalar.duration_bucket(F.col("v")).alias("b")).collect()]
    assert got == [0, 0, 0, 1, 1, 9, 10, 62, 62]
    tags = ["1", "t", "TRUE", "yes", "-42", "9223372036854775808", "1.5", "1.", "1e3", "a.b", ""]
    got = [r.t for r in spark.createDataFrame([(v,) for v in tags], "v string").select(scalar.typed_tag_type(F.col("v")).alias("t")).collect()]
    assert got == ["bool", "bool", "bool", "string", "int64", "string", "float64", "float64", "string", "string", "string"]
    rng = spark.range(1).select(*(scalar.duration_range(F.lit(b)).alias(f"b{b}") for b in (0, 10, 20, 63)), scalar.duration_range(F.lit(64)).alias("x"), scalar.human_duration(F.lit(1_500_000)).alias("h")).first()
    assert (rng.b0, rng.b10, rng.b20, rng.x, rng.h) == ("1ns-2ns", "1µs-2µs", "1ms-2ms", "invalid", "1.50ms")


def test_exemplars(spark):
    base = 1000 * S
    d = spans(spark, [{"span_id": str(i), "trace_id": str(i), "start_time": base + m * MIN, "duration": x * MS} for i, m, x in ((1, 0, 100), (2, 2, 200), (3, 6, 300))])
    got = exemplars.with_lookback(d, base + 5 * MIN, base + 12 * MIN, MIN, 5 * MIN, 10).groupBy("bucket").agg(F.sort_array(F.collect_list(F.col("span_id").substr(16, 1).cast("int"))).alias("x")).collect()
    got = {(r.bucket - base) // MIN: r.x for r in got}
    assert got[5] == [1, 2] and got[6] == [2] and got[7] == [2, 3] and got[11] == [3] and 12 not in got
    got = {(r.bucket - base) // MIN: r.span_id[-1] for r in exemplars.by_step(d, base, base + 12 * MIN, MIN).collect()}
    assert got == {0: "1", 2: "2", 6: "3"}
    one = exemplars.by_step(d, base, base + 12 * MIN, 12 * MIN, 2)
    assert [r.span_id[-1] for r in one.orderBy("rank").collect()] == ["3", "2"]
    assert [r.span_id[-1] for r in exemplars.by_step(d, base, base + 12 * MIN, 12 * MIN, 1, "fastest").collect()] == ["1"]
    assert exemplars.by_step(d, base, base + 12 * MIN, 12 * MIN, 2, "random").count() == 2
    assert exemplars.in_duration_bucket(one, 28).count() == 1
    assert exemplars.fetch_limit(1) == 50 and exemplars.fetch_limit(5, True) == 1000 and exemplars.fetch_limit(3) == 90


@pytest.fixture
def family(spark):
    return spans(spark, [
        {"trace_id": "123", "span_id": "1", "start_time": T, "service_name": "gate", "name": "GET", "tags": {"http.method": "GET", "service.name": "gate"}},
        {"trace_id": "123", "span_id": "2", "parent_span_id": "1", "start_time": T + 10 * MS, "duration": 40 * MS, "service_name": "db", "name": "SELECT", "tags": {"status.code": "error"}},
        {"trace_id": "123", "span_id": "3", "parent_span_id": "1", "start_time": T + 5 * MS, "duration": 3 * MS, "service_name": "redis", "name": "get"},
        {"trace_id": "123", "span_id": "5", "parent_span_id": "2", "start_time": T + 11 * MS, "duration": MS, "service_name": "db", "name": "row"},
        {"trace_id": "456", "span_id": "4", "parent_span_id": "99", "start_time": T + 60 * MIN, "duration": 200 * MS, "service_name": "gate", "name": "POST"},
    ])


def test_trace_documents(spark, family):
    e = Engine(family)
    doc = e.trace_document("123").first()
    assert [s.operationName for s in doc.spans] == ["GET", "get", "SELECT", "row"] and {k: v.serviceName for k, v in doc.processes.items()} == {"p1": "gate", "p2": "redis", "p3": "db"}
    assert doc.spans[0].references == [] and doc.spans[2].references[0].spanID.endswith("1") and [t.key for t in doc.spans[0].tags] == ["http.method"]
    assert [t.key for t in doc.processes["p1"].tags] == ["service.name"]
    s = {r.trace_id[-3:]: r for r in traces.summary(family).collect()}
    assert (s["123"].root_name, s["123"].span_count, s["123"].error_count, s["123"].duration_ms) == ("GET", 4, 1, 100) and s["456"].root_name == "POST"
    assert [r.traceID[-3:] for r in e.search_traces(service="gate", limit=1).collect()] == ["456"]
    assert e.search_traces(tags={"http.method": "GET"}, min_duration=50 * MS).count() == 1 and e.search_traces(max_duration=MS).first().traceID.endswith("123")
    m = e.search("{status.code=\"error\"}").first()
    assert m.serviceStats["db"].errorCount == 1 and m.spanSets[0].matched == 4 or m.spanSets[0].matched >= 1
    o = {r.service_name: r for r in e.trace_otlp("123").collect()}
    assert len(o) == 3 and o["gate"].scopeSpans[0].spans[0].parentSpanId == "" and o["gate"].resource.attributes[0].key == "service.name"
    assert [r.span_id[-1] for r in e.trace("123").collect()] == ["1", "3", "2", "5"]


def test_trees(spark, family):
    t = {r.span_id[-1]: (r.depth, r.root_span_id[-1], r.sibling) for r in traces.tree(family).collect()}
    assert t == {"1": (0, "1", 1), "3": (1, "1", 1), "2": (1, "1", 2), "5": (2, "1", 1), "4": (0, "4", 1)}
    e = Engine(family)
    assert [(r.span_id[-1], r.depth) for r in e.trace_tree("123").collect()] == [("1", 0), ("3", 1), ("2", 1), ("5", 2)]
    assert [r.span_id[-1] for r in e.trace_tree("123", [f"{2:016x}"]).collect()] == ["1", "3", "2"]
    assert [x[-1] for x in traces.ancestors(family, "123".rjust(32, "0"), f"{5:016x}")] == ["2", "1"]
    assert [r.span_id[-1] for r in traces.orphans(family).collect()] == ["4"] and traces.roots(family).count() == 1
    loop = spans(spark, [{"span_id": "1", "parent_span_id": "2", "start_time": T}, {"span_id": "2", "parent_span_id": "1", "start_time": T}])
    assert traces.tree(loop).count() == 2  # a cycle ends


def test_lookups(spark, family):
    assert lookups.by_span_id(family, "2").count() == 1 and lookups.by_span_ids(family, ["1", "2", "zz"]).count() == 2 and lookups.by_trace_id(family, "123").count() == 4
    assert [r.key for r in lookups.present_keys(family).orderBy("key").collect()] == ["http.method", "service.name", "status.code"]
    r = lookups.attribute_keys(family, T, T + 90 * MIN, 2).collect()
    assert [x.key for x in r] == ["http.method", "service.name"] and all(x.limited for x in r)
    assert [x.service_name for x in lookups.services(family, T, T + MIN).collect()] == ["db", "gate", "redis"]
    twice = lookups.union_first(family.limit(3), family, family)
    assert twice.count() == 5 and lookups.union_first(twice, family).count() == 5
    links = spark.createDataFrame([(f"{1:016x}", "9" * 32, "8" * 16, {"a": "b"}), (f"{1:016x}", "7" * 32, "6" * 16, None)], "span_id string, linked_trace_id string, linked_span_id string, attributes map<string,string>")
    got = {r.span_id[-1]: len(r.links) for r in Engine(family, links).select(include_links=True).collect()}
    assert got["1"] == 2 and got["2"] == 0


def test_prometheus_json(spark, family):
    e = Engine(family)
    out = e.query_range("rate({}[5m])", T, T + 10 * MIN, "1m", exemplars_per_step=1)
    assert out["data"]["resultType"] == "matrix" and len(out["data"]["result"]) == 4 and out["data"]["exemplars"]
    assert json.loads(to_json(out))["status"] == "success"
    out = e.query_range("{}", T, T + 10 * MIN)
    assert sum(float(v) for s in out["data"]["result"] for _, v in s["values"]) == 4
    assert e.query_range("count by (service_name) ({})", T, T + 2 * 60 * MIN)["data"]["result"][1]["metric"] == {"service_name": "gate"}
    assert e.query_range("histogram_quantile(0.9, {})", T, T + MIN)["data"]["resultType"] == "scalar"
    assert len(list(e.query_stream("{}", T, T + MIN))) == 4


def test_sql(spark, family):
    e = Engine(family)
    assert e.sql("SELECT * FROM spans WHERE duration > 100000000")[0] == "spans" and e.sql("SELECT count(*) AS n FROM spans")[1].first().n == 5


OTLP = {"resourceSpans": [{
    "resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "shop"}}, {"key": "n", "value": {"intValue": "7"}}]},
    "scopeSpans": [{"scope": {"name": "lib", "version": "2"}, "spans": [
        {"traceId": "0102030405060708090A0b0c0d0e0f10", "spanId": "0102030405060708", "parentSpanId": "0000000000000001", "name": "do", "kind": 3, "startTimeUnixNano": "1000", "endTimeUnixNano": "3000",
         "attributes": [{"key": "n", "value": {"doubleValue": 1.5}}, {"key": "ok", "value": {"boolValue": True}}, {"key": "l", "value": {"arrayValue": {"values": []}}}], "status": {"code": 2, "message": "test error"},
         "links": [{"traceId": "aa", "spanId": "bb", "attributes": [{"key": "x", "value": {"stringValue": "y"}}]}]},
        {"traceId": "01", "spanId": "02", "name": "bare", "startTimeUnixNano": "5", "endTimeUnixNano": "6"}]}]}]}


def test_otlp(spark):
    d = spark.createDataFrame([(json.dumps(OTLP),)], "value string")
    r = {x.name: x for x in otlp.spans(d).collect()}
    assert r["do"].trace_id == "0102030405060708090a0b0c0d0e0f10" and r["do"].parent_span_id == "0000000000000001" and r["do"].duration == 2000 and r["do"].service_name == "shop"
    assert r["do"].tags == {"service.name": "shop", "n": "1.500000", "scope.name": "lib", "scope.version": "2", "ok": "true", "l": "[array]", "span.kind": "client", "status.code": "error", "status.message": "test error", "name": "do", "parent_span_id": "0000000000000001"}
    assert r["bare"].parent_span_id is None and r["bare"].tags["span.kind"] == "unspecified" and r["bare"].tags["status.code"] == "unset"
    k = otlp.links(d).first()
    assert (k.linked_trace_id, k.linked_span_id, k.attributes) == ("aa".rjust(32, "0"), "bb".rjust(16, "0"), {"x": "y"})


def test_store(spark, tmp_path):
    s = store.SpanStore(spark, str(tmp_path / "t"))
    assert s.read().count() == 0 and s.version() == 0
    mk = lambda a, n: spans(spark, [{"span_id": f"{a + i:x}", "start_time": T + (a + i) * S} for i in range(n)])
    v1 = s.append(mk(1, 5), segment=0)
    v2 = s.append(mk(4, 5), segment=1)
    assert s.read().count() == 10 and s.read(snapshot=v1).count() == 5 and s.version() == v2
    assert s.read(T + 6 * S + 200 * MS, T + 100 * S).count() == 2
    assert s.compact(now_ns=store.time.time_ns()) == []  # not old enough
    later = store.time.time_ns() + 3600 * S
    assert len(s.compact(now_ns=later)) == 1 and s.read().count() == 8 and s.read(snapshot=v2).count() == 10
    assert [(r.level, r.blocks) for r in s.stats().collect()] == [(1, 1)]
    s.append(mk(100, 2), segment=3)
    s.append(mk(110, 2), segment=4)
    assert s.checkpointed(1) == 1
    with_gap = s.manifest().where("level = 0 or min_segment = 0")
    assert [(r.missing, r.next) for r in store.segment_gaps(with_gap).collect()] == [(2, 3)]
    assert len(s.retain(50 * S, T + 100 * S)) == 1 and s.read().count() == 4 and len(s.vacuum()) == 3 and s.read().count() == 4
    assert store.should_flush(1_000_000, 0, 1) and not store.should_flush(5, 0, 1)


def test_streams(spark, tmp_path):
    d = spans(spark, [{"span_id": f"{i + 1:x}", "start_time": T + i * 10 * S} for i in range(60)])
    d.drop("bucket1s", "duration_bucket").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.drop("bucket1s", "duration_bucket").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    s = store.SpanStore(spark, str(tmp_path / "t"))
    for _ in range(2):  # a restart adds nothing
        s.ingest(stream, str(tmp_path / "c")).awaitTermination()
    assert s.read().count() == 60 and s.manifest().count() == 3
    r = windows.rate(stream, "5 minutes", "1 minute", 300.0)
    q = r.writeStream.format("memory").queryName("live_rate").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    live = {x.time_ns: x.value for x in spark.table("live_rate").collect()}
    batch = {x.time_ns: x.value for x in series.rate(d, T, T + 14 * MIN, MIN, 5 * MIN).collect()}
    assert batch and all(live[k] == v for k, v in batch.items())
    h = windows.heatmap(stream.withColumn("duration_bucket", scalar.duration_bucket(F.col("duration"))), "1 minute")
    h.writeStream.format("memory").queryName("live_heat").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("live_heat").agg(F.sum("count")).first()[0] == 60
    w = windows.sessions(stream, "30 seconds")
    w.writeStream.format("memory").queryName("live_sessions").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("live_sessions").count() == 1


def test_tag_values_are_not_limited(spark):
    n = 1_000_500
    d = spark.range(n).select(F.create_map(F.lit("request.id"), F.format_string("r%07d", "id")).alias("tags"), F.lit(T).alias("start_time"), F.lit(T + 1).alias("end_time"))
    got = lookups.tag_values(d, "span.request.id", T, T + MIN)
    assert got.columns == ["value"] and got.agg(F.count("*"), F.max("value")).first()[:] == (n, f"r{n - 1:07d}")


def test_limits_of_correlated_subqueries_follow_their_order(spark, sf):
    """Rows are numbered in the order that ORDER BY names, also by a column that is not selected."""
    from spanloom import queries
    from spanloom import sql as spansql

    spansql.register(*queries.tables(spark, sf))
    inner = "SELECT span_id FROM spans s WHERE s.service_name = v.service_name ORDER BY duration DESC, span_id LIMIT 1"
    outer = "(SELECT DISTINCT service_name FROM spans) v"
    best = {r.service_name: r.span_id for r in spark.sql("SELECT service_name, max_by(span_id, struct(duration, -conv(span_id, 16, 10))) AS span_id FROM spans GROUP BY 1").collect()}
    for text in (f"SELECT v.service_name, t.span_id FROM {outer}, LATERAL ({inner}) t", f"SELECT service_name, ({inner}) AS span_id FROM {outer}", f"WITH d AS (SELECT DISTINCT service_name FROM spans) SELECT service_name, coalesce(({inner}), '') AS span_id FROM d v"):
        d = spansql.query(spark, text)[1]
        windows = [x for x in d._jdf.queryExecution().optimizedPlan().toString().split("\n") if "row_number() windowspecdefinition" in x]
        assert windows and all("DESC NULLS LAST" in x.split("specifiedwindowframe")[0] for x in windows)
        assert dict(map(tuple, d.collect())) == best
