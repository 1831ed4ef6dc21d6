import threading

import pytest
from helpers import MS, S, spans
from pyspark.sql import functions as F

from spanloom.engine import Engine
from spanloom.operators import joins, traces
from spanloom.operators.matchers import Matcher
from spanloom.streaming import store
from spanloom.streaming.log import FOLD, Log

T = 1_700_000_000 * S
LINK = "span_id string, linked_trace_id string, linked_span_id string, attributes map<string,string>"


def some(spark, first, n, **more):
    return spans(spark, [{"span_id": f"{first + i:x}", "start_time": T + (first + i) * S, "tags": {"k": str(i % 2)}} | more for i in range(n)])


def test_two_writers_never_commit_one_version(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"), store._LOG)
    won = []

    def write(name):
        for v in range(1, 9):
            if log.publish(v, [{"block": f"{name}{v}", "version": v, "removed": False}]):
                won.append(v)

    threads = [threading.Thread(target=write, args=(x,)) for x in "abcd"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(won) == list(range(1, 9)) == log.versions() and log.read().count() == 8
    assert not [x for x in (tmp_path / "log").iterdir() if x.name.startswith(".")]


def test_concurrent_appends_and_conflicts(spark, tmp_path):
    s = store.SpanStore(spark, str(tmp_path / "t"))
    d = some(spark, 1, 4)
    threads = [threading.Thread(target=s.append, args=(d,), kwargs={"block": f"w{i}"}) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert s.version() == 4 and s.manifest().count() == 4 and s.read().count() == 16
    made = s.compact(now_ns=store.time.time_ns() + 3600 * S)
    assert len(made) == 1 and s.read().count() == 4
    with pytest.raises(store.Conflict):
        s._commit([], ["w0"])  # another compaction already took it out


def test_a_lost_writer_leaves_nothing_visible(spark, tmp_path):
    s = store.SpanStore(spark, str(tmp_path / "t"))
    s.append(some(spark, 1, 3), block="a")
    s._write(some(spark, 10, 3), None, "b", 0)  # died before its commit
    assert s.read().count() == 3 and s.vacuum() == []  # it may still be at work
    assert s.vacuum(orphan_age=-10) == ["b"] and s.read().count() == 3
    s.append(some(spark, 10, 3), block="b")  # the retry
    assert s.read().count() == 6


def test_log_is_folded(spark, tmp_path):
    s = store.SpanStore(spark, str(tmp_path / "t"))
    s.append(some(spark, 1, 2), block="real")
    for i in range(FOLD + 2):
        s._commit([{"block": f"x{i}", "path": "p", "min_time": 1, "max_time": 2, "span_count": 0, "level": 3}], [f"x{i - 1}"] if i else [])
    assert [n for n in s.log._names() if n.endswith(".folded")] and {r.block for r in s.manifest().collect()} == {"real", f"x{FOLD + 1}"}
    assert {r.block for r in s.manifest(3).collect()} == {"real", "x1"} and s.version() == FOLD + 3


def test_links_attributes_and_compaction(spark, tmp_path):
    s = store.SpanStore(spark, str(tmp_path / "t"))
    links = spark.createDataFrame([(f"{1:016x}", "9" * 32, "8" * 16, {"a": "b"})], LINK)
    s.append(some(spark, 1, 4), links=links, segment=1)
    late = some(spark, 3, 4).withColumn("name", F.lit("later")).withColumn("start_time", F.col("start_time") + 1)
    s.append(late, links=links, segment=2)
    assert s.read_links().count() == 2 and s.by_attribute("k", "1").count() == 4 and s.read_attributes().count() == 8
    s.compact(now_ns=store.time.time_ns() + 3600 * S)
    got = {int(r.span_id, 16): r.name for r in s.read().collect()}
    assert got == {1: "op", 2: "op", 3: "op", 4: "op", 5: "later", 6: "later"}  # of two copies the earliest stays
    assert [r.attributes for r in s.read_links().collect()] == [{"a": "b"}]
    e = Engine.from_store(s)
    assert {len(r.links) for r in e.select([Matcher("span_id", "=", f"{1:016x}")], include_links=True).collect()} == {1}
    kind, rows, stats = e.query_with_stats('count({k="1"})', T, T + 100 * S)
    assert stats["spans_scanned"] == 3 and stats["blocks"] == stats["blocks_scanned"] == 1 and [r.value for r in rows] == [3.0]


def test_head_flush_checkpoint_replay(spark, tmp_path):
    s = store.SpanStore(spark, str(tmp_path / "t"))
    assert s.flush() is None and s.head().count() == 0
    for i in range(3):
        assert s.write_head(some(spark, 10 * i + 1, 2)) == i + 1
    assert s.read(include_head=True).count() == 6 and s.read().count() == 0 and s.flush() is None  # neither large nor long
    assert s.head(upto=2).count() == 4
    s.flush(force=True)
    again = store.SpanStore(spark, str(tmp_path / "t"))  # a restart
    assert again.replay().count() == 0 and again.read().count() == again.read(include_head=True).count() == 6
    assert again.checkpoint() == [] and again.checkpoint(2) == [1, 2, 3] and again.write_head(some(spark, 50, 2)) == 4
    assert [r.segment for r in again.replay().collect()] == [4] and [r.commit_seq for r in again.head().collect()] == [4, 4]
    far = spans(spark, [{"span_id": "99", "start_time": T + 3 * 3600 * S}])
    again.write_head(far)
    done = again.maintain(now_ns=store.time.time_ns())
    assert done["flush"] and done["compact"] == [] and again.replay().count() == 0 and again.read().count() == 9
    assert again.manifest().where("min_segment = 4 and max_segment = 5").count() == 1


def test_background_work(spark, tmp_path):
    s = store.SpanStore(spark, str(tmp_path / "t"))
    s.write_head(spans(spark, [{"span_id": "1", "start_time": T}, {"span_id": "2", "start_time": T + 3 * 3600 * S}]))
    stop = s.maintaining(intervals=dict.fromkeys(store.INTERVALS, 0.2))
    for _ in range(200):
        if s.version():
            break
        store.time.sleep(0.2)
    stop.set()
    assert s.read().count() == 2


@pytest.mark.parametrize("shape", ["flat", "chain"])
def test_large_trees(spark, shape):
    n = 20_000
    d = spark.range(n).select(
        F.lit("1" * 32).alias("trace_id"), F.format_string("%016x", F.col("id") + 1).alias("span_id"),
        F.when(F.col("id") > 0, F.format_string("%016x", F.lit(1) if shape == "flat" else F.col("id"))).alias("parent_span_id"), (F.lit(T) + F.col("id")).alias("start_time"),
    )
    got = traces.tree(d).agg(F.max("depth"), F.countDistinct("root_span_id"), F.count("*"), F.max("sibling")).first()
    assert tuple(got) == ((1, 1, n, n - 1) if shape == "flat" else (n - 1, 1, n, 1))


def test_time_joins(spark):
    a = [(("x", "y")[i % 2], i * 700) for i in range(40)] + [("z", 5), (None, 9)]
    b = [(("x", "y")[i % 2], i * 1300, f"v{i:02d}") for i in range(12)] + [("x", 1300 * 4, "v99"), (None, 3, "n")]
    left, right = spark.createDataFrame(a, "k string, start_time long"), spark.createDataFrame(b, "k string, start_time long, v string")
    want = sorted(((k, t, max(((u, v) for q, u, v in b if q == k and u <= t), default=(0, None))[1]) for k, t in a), key=str)
    for width in (100, 2000, 10**9):
        assert sorted(map(tuple, joins.asof(left, right, ["k"], "v", "last", width=width).collect()), key=str) == want
        got = joins.during(left, right.withColumn("end_time", F.col("start_time") + 1500), by=["k"], width=width).select("p.start_time", "i.v").collect()
        assert sorted(map(tuple, got)) == sorted((t, v) for k, t in a for q, u, v in b if k is not None and q == k and u <= t <= u + 1500)
    assert joins.asof(left.limit(0), right, ["k"], "v", "last").count() == 0 and MS
