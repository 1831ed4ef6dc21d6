"""Spans, their attributes and links as immutable Parquet blocks under a log of versions: ingest, head, snapshots, compaction, retention.

A block is a directory of three tables: ``spans`` by time, ``attributes`` (span_id, key, value) by key and value, ``links`` by span.  The log says
which blocks a version has; readers see the blocks of one version only, so a failed or half-written batch is never visible, and a repeated
batch replaces its own block.  Two writers never commit one version: the second one finds the number taken, looks again at what the
first one did, and takes the next number or gives up (:class:`Conflict`).

Spans that are not yet worth a block wait in the *head*: numbered segments, visible to readers at once, which :meth:`SpanStore.flush` turns into a
block and :meth:`SpanStore.checkpoint` deletes once their block is committed.  After a restart the head is what no block holds.
"""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import lookups
from ..schema import LINKS, MANIFEST, SPANS, with_generated
from .log import FOLD, Log

MINUTE, HOUR = 60, 3600
SECOND = 1_000_000_000
_LOG = T.StructType([*MANIFEST, T.StructField("removed", T.BooleanType()), T.StructField("version", T.LongType())])
_SEGMENT = T.StructType([T.StructField("segment", T.LongType()), T.StructField("path", T.StringType()), T.StructField("min_time", T.LongType()), T.StructField("max_time", T.LongType()), T.StructField("span_count", T.LongType())])
ATTRIBUTES = T.StructType([T.StructField("span_id", T.StringType()), T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
#: Files of blocks that were never committed are left alone for so long: their writer may still be at work.
ORPHAN_AGE = 24 * HOUR
#: Seconds between two flushes, checkpoints, compactions and retentions of a running store.
INTERVALS = {"flush": 10, "checkpoint": 60, "compact": 300, "retain": 3600}
#: Fixed value: segments in blocks from which they are deleted.
CHECKPOINT_SEGMENTS = 5


class Conflict(RuntimeError):
    """Another writer has taken out a block that this commit was made from."""


@dataclass(frozen=True)
class Level:
    level: int
    min_age: int  # seconds
    min_blocks: int = 2


#: Minimum age of the blocks of each level.
LEVELS = (Level(0, 10 * MINUTE), Level(1, 2 * HOUR), Level(2, 4 * HOUR), Level(3, 8 * HOUR), Level(4, 48 * HOUR), Level(5, 336 * HOUR))
#: Spans and time range from which a batch is flushed on its own.
FLUSH_SPANS, FLUSH_RANGE = 1_000_000, 2 * HOUR * 1_000_000_000


def should_flush(span_count: int, min_time: int, max_time: int) -> bool:
    return span_count >= FLUSH_SPANS or max_time - min_time >= FLUSH_RANGE


class SpanStore:
    def __init__(self, spark: SparkSession, path: str, row_group_bytes: int = 128 << 20):
        self.spark, self.path, self.row_group = spark, path.rstrip("/"), row_group_bytes
        self.log = Log(spark, f"{self.path}/log", _LOG)
        self.segments = Log(spark, f"{self.path}/head", _SEGMENT)

    # ------------------------------------------------------------ versions

    def manifest(self, snapshot: int | None = None) -> DataFrame:
        """Blocks that stand after version ``snapshot`` (the newest, if none is given)."""
        last = W.partitionBy("block").orderBy(F.col("version").desc(), F.col("removed").desc())
        return self.log.read(snapshot).withColumn("__n", F.row_number().over(last)).where("__n = 1 and not removed").drop("__n", "removed", "version")

    def version(self) -> int:
        return self.log.last()

    def _commit(self, added: list[dict], removed: list[str]) -> int:
        names = MANIFEST.fieldNames()
        while True:
            v = self.version() + 1
            if removed:
                stand = {r.block for r in self.manifest(v - 1).where(F.col("block").isin(removed)).select("block").collect()}
                if gone := sorted(set(removed) - stand):
                    raise Conflict(f"block {gone[0]} is no longer there")
            rows = [{f: a.get(f) for f in names} | {"removed": False, "version": v} for a in added] + [{"block": b, "removed": True, "version": v} for b in removed]
            if self.log.publish(v, rows):
                break
        if v % FOLD == 0:
            self.log.fold(v, [r.asDict() | {"removed": False, "version": v} for r in self.manifest(v).collect()])  # a row a block
        return v

    # ------------------------------------------------------------ writes

    def _table(self, d: DataFrame, path: str, order: tuple[str, ...], blooms: tuple[str, ...]) -> None:
        writer = d.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "snappy").option("parquet.block.size", self.row_group)
        for c in blooms:  # point lookups skip row groups
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(path)

    def _write(self, spans: DataFrame, links: DataFrame | None, block: str, level: int, **more) -> dict:
        path = f"{self.path}/blocks/{block}"
        self._table(spans.select(*SPANS.fieldNames()), f"{path}/spans", ("start_time", "trace_id", "span_id"), ("trace_id", "span_id"))
        own = self.spark.read.schema(SPANS).parquet(f"{path}/spans")  # what was written, so that all three tables agree
        self._table(lookups.attributes(own), f"{path}/attributes", ("key", "value", "span_id"), ("value",))
        links = self.spark.createDataFrame([], LINKS) if links is None else links.select(*LINKS.fieldNames())
        self._table(links, f"{path}/links", ("span_id", "linked_trace_id", "linked_span_id"), ("span_id",))
        s = own.agg(F.min("start_time").alias("a"), F.max("end_time").alias("b"), F.count("*").alias("n")).first()
        return {"block": block, "path": path, "min_time": s.a, "max_time": s.b, "span_count": s.n, "level": level, "created_at": time.time_ns(), **more}

    def append(self, spans: DataFrame, segment: int | None = None, block: str | None = None, links: DataFrame | None = None, last_segment: int | None = None) -> int:
        """Add spans and links as one block of level 0 and return the version that shows it.  With a block name, a repeated call replaces
        what an earlier try wrote."""
        block = block or f"b-{uuid.uuid4().hex}"
        upto = segment if last_segment is None else last_segment
        meta = self._write(spans, links, block, 0, min_segment=segment, max_segment=upto)
        return self._commit([meta | {"commit_seq": upto}], []) if meta["span_count"] else self.version()

    def ingest(self, stream: DataFrame, checkpoint: str, trigger: dict | None = None):
        """Structured Streaming sink: every micro-batch is one block, named by its batch number, so a repeated batch does not add
        rows twice.  An array column ``links`` of the stream is stored as the spans' links."""
        known = lambda block: bool(self.manifest().where(F.col("block") == block).head(1))

        def sink(batch: DataFrame, number: int) -> None:
            block = f"batch-{number:012d}"
            if not known(block):
                links = batch.select("span_id", F.explode("links").alias("l")).select("span_id", "l.*") if "links" in batch.columns else None
                self.append(batch, segment=number, block=block, links=links)

        return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    # ------------------------------------------------------------ head

    def write_head(self, spans: DataFrame, links: DataFrame | None = None) -> int:
        """Add spans to the head as one segment and return its number; readers see it at once."""
        path = f"{self.path}/segments/{uuid.uuid4().hex}"
        spans.select(*SPANS.fieldNames()).write.parquet(f"{path}/spans")
        (self.spark.createDataFrame([], LINKS) if links is None else links.select(*LINKS.fieldNames())).write.parquet(f"{path}/links")
        s = self.spark.read.schema(SPANS).parquet(f"{path}/spans").agg(F.min("start_time").alias("a"), F.max("end_time").alias("b"), F.count("*").alias("n")).first()
        while True:
            n = max(self.segments.last(), self._flushed()) + 1
            if self.segments.publish(n, [{"segment": n, "path": path, "min_time": s.a, "max_time": s.b, "span_count": s.n}]):
                return n

    def _flushed(self) -> int:
        """The last segment that a block holds."""
        return self.log.read().agg(F.max("max_segment").alias("m")).first().m or 0

    def replay(self) -> DataFrame:
        """Segments of the head that no block holds, in order: what a restarted store goes on with."""
        return self.segments.read().where(F.col("segment") > self._flushed()).orderBy("segment")

    def head(self, table: str = "spans", upto: int | None = None) -> DataFrame:
        """Spans (or links) of the head with their segment as ``commit_seq``; of a snapshot, those up to a segment."""
        schema, d = (SPANS if table == "spans" else LINKS), None
        for r in self.replay().collect():  # a row a segment
            own = self.spark.read.schema(schema).parquet(f"{r.path}/{table}").withColumn("commit_seq", F.lit(r.segment).cast("long"))
            d = own if d is None else d.unionByName(own)
        if d is None:
            d = self.spark.createDataFrame([], schema).withColumn("commit_seq", F.lit(None).cast("long"))
        return lookups.visible(d, upto) if upto is not None else d

    def flush(self, force: bool = False) -> int | None:
        """Turn the head into a block of level 0, if it is large or long enough; returns the new version."""
        s = self.replay().agg(F.sum("span_count").alias("n"), F.min("min_time").alias("a"), F.max("max_time").alias("b"), F.min("segment").alias("first"), F.max("segment").alias("last")).first()
        if not s.n or not (force or should_flush(s.n, s.a, s.b)):
            return None
        # the block is named by its segments: a repeated flush replaces what a lost one wrote
        return self.append(self.head(upto=s.last), segment=s.first, block=f"h-{s.first:012d}-{s.last:012d}", links=self.head("links", s.last), last_segment=s.last)

    def checkpoint(self, threshold: int = CHECKPOINT_SEGMENTS) -> list[int]:
        """Delete segments that blocks hold, once there are more than ``threshold`` of them."""
        done = self.segments.read().where(F.col("segment") <= self._flushed()).orderBy("segment").collect()
        if len(done) <= threshold:
            return []
        for r in done:
            for path in (f"{self.path}/head/{r.segment:020d}.json", r.path):
                p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                self.segments._fs.delete(p, True)
        return [r.segment for r in done]

    # ------------------------------------------------------------ reads

    def _paths(self, start: int | None, end: int | None, snapshot: int | None, table: str) -> list[str]:
        m = overlapping(self.manifest(snapshot), start, end).orderBy("min_time", "block").select("path").collect()  # a row a block
        return [f"{r.path}/{table}" for r in m]

    def read(self, start: int | None = None, end: int | None = None, snapshot: int | None = None, include_head: bool = False) -> DataFrame:
        """Spans of the blocks that may overlap [start, end]; blocks outside are not opened.  With the head, a span in both counts once."""
        paths = self._paths(start, end, snapshot, "spans")
        d = self.spark.read.schema(SPANS).parquet(*paths) if paths else self.spark.createDataFrame([], SPANS)
        if include_head:
            d = lookups.union_first(d, self.head().drop("commit_seq"), by=("trace_id", "span_id"))
        if start is not None:
            d = d.where(F.col("end_time") >= start)
        if end is not None:
            d = d.where(F.col("start_time") <= end)
        return with_generated(d)

    def read_links(self, start: int | None = None, end: int | None = None, snapshot: int | None = None, include_head: bool = False) -> DataFrame:
        """Links of the spans in the blocks that may overlap [start, end]."""
        paths = self._paths(start, end, snapshot, "links")
        d = self.spark.read.schema(LINKS).parquet(*paths) if paths else self.spark.createDataFrame([], LINKS)
        return d.unionByName(self.head("links").drop("commit_seq")) if include_head else d

    def read_attributes(self, start: int | None = None, end: int | None = None, snapshot: int | None = None) -> DataFrame:
        """(span_id, key, value) of the blocks that may overlap [start, end], sorted by key and value inside files."""
        paths = self._paths(start, end, snapshot, "attributes")
        return self.spark.read.schema(ATTRIBUTES).parquet(*paths) if paths else self.spark.createDataFrame([], ATTRIBUTES)

    def by_attribute(self, key: str, value: str, start: int | None = None, end: int | None = None, snapshot: int | None = None) -> DataFrame:
        """Spans with an attribute value: the sorted attribute tables give the ids, spans are semi-joined to them."""
        ids = self.read_attributes(start, end, snapshot).where((F.col("key") == key) & (F.col("value") == value)).select("span_id")
        return lookups.by_span_ids(self.read(start, end, snapshot), ids)

    def stats(self) -> DataFrame:
        m = self.manifest()
        return m.groupBy("level").agg(F.count("*").alias("blocks"), F.sum("span_count").alias("spans"), F.min("min_time").alias("min_time"), F.max("max_time").alias("max_time"))

    def described(self) -> DataFrame:
        """(block, text): a line about each block."""
        return pretty(self.manifest())

    # ------------------------------------------------------------ maintenance

    def compact(self, now_ns: int | None = None, levels=LEVELS) -> list[str]:
        """Merge every level that is due into one block of the next level: spans deduplicated (the earliest copy stays) and sorted by time, with their links."""
        made = []
        for row in compaction_plan(self.manifest(), now_ns or time.time_ns(), levels).orderBy("level").collect():
            own = self.manifest().where(F.col("block").isin(row.blocks))
            if gaps := segment_gaps(own).collect():
                raise ValueError(f"segment {gaps[0].missing} is missing before blocks of level {row.level} can be merged")
            blocks = own.collect()
            d = lookups.deduplicated(self.spark.read.schema(SPANS).parquet(*(f"{b.path}/spans" for b in blocks)))
            links = self.spark.read.schema(LINKS).parquet(*(f"{b.path}/links" for b in blocks)).withColumn("attributes", F.array_sort(F.map_entries("attributes"))).distinct().withColumn("attributes", F.map_from_entries("attributes"))
            per = max(1, sum(b.span_count for b in blocks) // FLUSH_SPANS)
            block = f"c-{uuid.uuid4().hex}"
            seg = [b.min_segment for b in blocks if b.min_segment is not None], [b.max_segment for b in blocks if b.max_segment is not None]
            meta = self._write(d.repartitionByRange(per, "start_time"), links, block, row.level + 1, sources=[b.block for b in blocks], min_segment=min(seg[0], default=None), max_segment=max(seg[1], default=None))
            self._commit([meta], [b.block for b in blocks])
            made.append(block)
        return made

    def retain(self, period_ns: int, now_ns: int | None = None) -> list[str]:
        """Take out blocks that ended before the period."""
        gone = [r.block for r in expired(self.manifest(), (now_ns or time.time_ns()) - period_ns).collect()]
        if gone:
            self._commit([], gone)
        return gone

    def checkpointed(self, threshold: int = CHECKPOINT_SEGMENTS) -> int | None:
        """Largest segment up to which all are in blocks, once there are more than ``threshold`` of them; replay starts behind it."""
        m = self.manifest().where("min_segment is not null")
        top = m.agg(F.max("max_segment").alias("m"), F.min("min_segment").alias("a")).first()
        if top.m is None or top.m - top.a < threshold:
            return None
        gap = segment_gaps(m).agg(F.min("missing").alias("g")).first().g
        return (gap - 1) if gap is not None else top.m

    def vacuum(self, keep_versions: int = 0, orphan_age: int = ORPHAN_AGE) -> list[str]:
        """Delete the files of blocks that no kept version shows.  Blocks that no version ever had are deleted only when older than ``orphan_age`` seconds."""
        now = self.version()
        kept = [self.manifest(v) for v in range(max(1, now - keep_versions), now + 1)] or [self.manifest()]
        shown = {r.block for m in kept for r in m.select("block").collect()}
        ever = {r.block for r in self.log.read().select("block").distinct().collect()}
        root, fs, gone = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/blocks"), self.log._fs, []
        oldest = time.time() - orphan_age
        for status in fs.listStatus(root) if fs.exists(root) else []:
            name = status.getPath().getName()
            if name not in shown and (name in ever or status.getModificationTime() / 1000 < oldest):
                fs.delete(status.getPath(), True)
                gone.append(name)
        return gone

    def maintain(self, now_ns: int | None = None, period_ns: int | None = None, jobs: tuple[str, ...] = tuple(INTERVALS)) -> dict:
        """One turn of the background work; a job that lost against another writer is left to the next turn."""
        run = {"flush": self.flush, "checkpoint": self.checkpoint, "compact": lambda: self.compact(now_ns), "retain": lambda: self.retain(period_ns, now_ns) if period_ns else []}
        done = {}
        for job in jobs:
            try:
                done[job] = run[job]()
            except Conflict as e:
                done[job] = e
        return done

    def maintaining(self, period_ns: int | None = None, intervals: dict[str, float] | None = None) -> threading.Event:
        """Run the background work in a thread, each job at its interval, until the event that is returned is set."""
        every, stop = INTERVALS | (intervals or {}), threading.Event()
        due = dict.fromkeys(every, time.monotonic())

        def loop() -> None:
            while not stop.wait(min(every.values()) / 2):
                now = time.monotonic()
                jobs = tuple(j for j in every if now - due[j] >= every[j])
                for j in jobs:
                    due[j] = now
                self.maintain(period_ns=period_ns, jobs=jobs)

        threading.Thread(target=loop, daemon=True).start()
        return stop


# ---------------------------------------------------------------- plans over manifests


def overlapping(manifest: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Blocks whose time range meets [start, end]; a block without times is always read."""
    unknown = F.coalesce((F.col("min_time") == 0) & (F.col("max_time") == 0), F.lit(True))
    ok = F.lit(True)
    if start is not None:
        ok = ok & (F.col("max_time") >= start)
    if end is not None:
        ok = ok & (F.col("min_time") <= end)
    return manifest.where(unknown | ok)


def compaction_plan(manifest: DataFrame, now_ns: int, levels=LEVELS) -> DataFrame:
    """(level, blocks, spans) of the levels with enough blocks of which the oldest is old enough."""
    rules = manifest.sparkSession.createDataFrame([(x.level, x.min_age * 1_000_000_000, x.min_blocks) for x in levels], "level int, min_age bigint, min_blocks int")
    d = manifest.groupBy("level").agg(F.array_sort(F.collect_list("block")).alias("blocks"), F.sum("span_count").alias("spans"), F.min("created_at").alias("oldest"), F.count("*").alias("n"))
    return d.join(F.broadcast(rules), "level").where((F.col("n") >= F.col("min_blocks")) & (F.lit(now_ns) - F.col("oldest") >= F.col("min_age"))).select("level", "blocks", "spans")


def segment_gaps(manifest: DataFrame) -> DataFrame:
    """(missing, next): the first missing segment of each gap in the blocks' segment ranges."""
    w = W.orderBy("min_segment", "max_segment").rowsBetween(W.unboundedPreceding, -1)
    d = manifest.where("min_segment is not null").select("min_segment", "max_segment", F.max("max_segment").over(w).alias("upto"))
    return d.where(F.col("upto").isNotNull() & (F.col("min_segment") > F.col("upto") + 1)).select((F.col("upto") + 1).alias("missing"), F.col("min_segment").alias("next"))


def expired(manifest: DataFrame, before_ns: int) -> DataFrame:
    return manifest.where(F.col("max_time") < before_ns)


def pretty(manifest: DataFrame) -> DataFrame:
    """(block, text): a line about each block of a manifest."""
    at = lambda c: F.date_format(F.timestamp_micros(F.call_function("div", F.col(c), F.lit(1000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.concat(F.lit("block "), "block", F.lit(" level "), F.coalesce(F.col("level").cast("string"), F.lit("?")), F.lit(", "), F.col("span_count").cast("string"), F.lit(" spans, "), at("min_time"), F.lit(" to "), at("max_time"))
    return manifest.select("block", text.alias("text"))
