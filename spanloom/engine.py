"""The engine: one object over a spans and a links table, with a method for each read surface."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from . import sql
from .functions import scalar
from .operators import exemplars, lookups, series, traces
from .operators.matchers import Matcher, select
from .plans import language
from .plans.planner import Options, Planner, execute, matchers_of
from .streaming.store import SpanStore, overlapping

DAY = 86400 * scalar.SECOND
#: Series and points of a collected answer, unless a caller says otherwise; what is left out is reported.
MAX_SERIES, MAX_POINTS = 10_000, 1_000_000


class Engine:
    def __init__(self, spans: DataFrame, links: DataFrame | None = None):
        self.spans, self.links = spans, links
        self.spark: SparkSession = spans.sparkSession
        self.store: SpanStore | None = None

    @classmethod
    def from_store(cls, store: SpanStore, start: int | None = None, end: int | None = None, snapshot: int | None = None, include_head: bool = False) -> Engine:
        """An engine over the blocks of a store that may overlap [start, end], and over its head if asked for."""
        e = cls(store.read(start, end, snapshot, include_head), store.read_links(start, end, snapshot, include_head))
        e.store = store
        return e

    # ------------------------------------------------------------ metric language

    def query(self, text: str, start: int | str, end: int | str, step: int | str = 0, limit: int | None = None, mode: str = "documented") -> tuple[str, DataFrame]:
        """(result type, plan) of an expression of the metric language."""
        step = scalar.parse_duration(step) if isinstance(step, str) and step else (step or 0)
        return execute(self.spans, text, Options(scalar.parse_time(start), scalar.parse_time(end), step, limit, mode))

    def query_with_stats(self, text: str, start: int, end: int, step: int = 0) -> tuple[str, list[Row], dict]:
        """(result type, rows, statistics): spans that left the scan, blocks read and blocks there are (with a store), rows and seconds."""
        began, seen = time.monotonic(), Observation()
        node = language.normalize(language.parse(text))
        language.validate(node)
        planner = Planner(self.spans, Options(start, end, step), seen)
        rows = planner.plan(node).collect()
        stats = {"spans_scanned": seen.get["spans"] if planner.observed else 0, "rows": len(rows), "seconds": time.monotonic() - began}
        if self.store is not None:
            m = self.store.manifest()
            stats |= {"blocks": m.count(), "blocks_scanned": overlapping(m, start, end).count()}
        return language.result_type(node), rows, stats

    def query_range(self, text: str, start: int | str | None = None, end: int | str | None = None, step: str = "", exemplars_per_step: int = 0, strategy: str = "slowest", max_series: int = MAX_SERIES, max_points: int = MAX_POINTS) -> dict:
        """Collected answer in the Prometheus JSON form: {status, data: {resultType, result}}; selectors become counts over time.  An answer
        goes through the driver, so it has ``max_series`` series and ``max_points`` points at most, in order of series and time, and says so in ``limited``;
        :meth:`query` gives the whole result as a DataFrame."""
        stop = scalar.parse_time(end) if end is not None else time.time_ns()
        begin = scalar.parse_time(start) if start is not None else stop - 3600 * scalar.SECOND
        width = scalar.parse_duration(step) if step else scalar.default_step(stop - begin)
        node = language.normalize(language.parse(text))
        language.validate(node)
        o = Options(begin, stop, width)
        kind = language.result_type(node)
        plan = Planner(self.spans, o).plan(node)
        if kind == "spans":
            kind, plan = "matrix", series.count_over_time(plan, begin, stop, width)
        found = []
        if exemplars_per_step:
            most = exemplars.fetch_limit(exemplars_per_step, language.bare_selector(node)[2]) * max(1, (stop - begin) // width + 1)
            rows = self.exemplars(text, begin, stop, width, exemplars_per_step, strategy)
            found = [r.asDict() for r in rows.orderBy("bucket", "rank").limit(most).collect()]
        data = to_prometheus(kind, plan, max_series, max_points)
        return {"status": "success", "data": data | ({"exemplars": found} if exemplars_per_step else {})}

    def query_stream(self, text: str, start: int, end: int, step: int = 0) -> Iterator[Row]:
        """Rows of a result as they come, a partition at a time."""
        return self.query(text, start, end, step)[1].toLocalIterator()

    def exemplars(self, text: str, start: int, end: int, step: int, count: int = 1, strategy: str = "slowest", by_series: bool = False) -> DataFrame:
        """Exemplars of the selector under an expression: from the lookback window for ranges, by cell for heatmaps, else by step."""
        selector, length, heat = language.bare_selector(language.parse(text))
        if selector is None:
            raise language.LanguageError("the expression has no selector")
        back = scalar.parse_duration(length) if length else 0
        d = select(self.spans, matchers_of(selector), start - back, end)
        if back:
            return exemplars.with_lookback(d, start, end, step, back, count, strategy, by_series)
        if heat:
            return exemplars.by_cell(d, start, end, step, count, strategy)
        return exemplars.by_step(d, start, end, step, count, strategy, by_series)

    # ------------------------------------------------------------ traces

    def select(self, matchers: Iterable[Matcher] = (), start: int | None = None, end: int | None = None, include_links: bool = False) -> DataFrame:
        d = select(self.spans, matchers, start, end)
        return lookups.with_links(d, self.links) if include_links and self.links is not None else d

    def search_traces(self, service: str | None = None, operation: str | None = None, tags: dict[str, str] | None = None, start: int | None = None, end: int | None = None, min_duration: int = 0, max_duration: int = 0, limit: int = 20) -> DataFrame:
        """Documents of the newest traces with a matching span."""
        ms = [Matcher("service_name", "=", service)] if service else []
        ms += [Matcher("name", "=", operation)] if operation else []
        ms += [Matcher(k, "=", v) for k, v in (tags or {}).items()]
        return traces.documents(traces.search(self.spans, ms, start, end, min_duration, max_duration, limit))

    def search(self, text: str = "{}", start: int | None = None, end: int | None = None, limit: int = 20) -> DataFrame:
        """Search metadata of the newest traces with a span of a selector."""
        node = language.parse(text)
        if not isinstance(node, language.Selector):
            raise language.LanguageError("search expects a selector")
        return traces.search_metadata(traces.search(self.spans, matchers_of(node), start, end, limit=limit))

    def trace(self, trace_id: str) -> DataFrame:
        return traces.detail(self.spans, trace_id)

    def trace_document(self, trace_id: str) -> DataFrame:
        return traces.documents(lookups.by_trace_id(self.spans, trace_id))

    def trace_otlp(self, trace_id: str) -> DataFrame:
        d = lookups.by_trace_id(self.spans, trace_id)
        return traces.resource_spans(lookups.with_links(d, self.links) if self.links is not None else d)

    def trace_tree(self, trace_id: str, collapsed: Sequence[str] = ()) -> DataFrame:
        return traces.flattened(self.spans, trace_id, collapsed)

    # ------------------------------------------------------------ discovery

    def services(self, start: int, end: int) -> DataFrame:
        return lookups.services(self.spans, start, end)

    def operations(self, start: int, end: int, service: str | None = None) -> DataFrame:
        return lookups.operations(self.spans, start, end, service)

    def attribute_keys(self, start: int, end: int, limit: int = 1000) -> DataFrame:
        return lookups.attribute_keys(self.spans, start, end, limit)

    def attribute_values(self, key: str, start: int, end: int, limit: int = 1000) -> DataFrame:
        return lookups.attribute_values(self.spans, key, start, end, limit)

    def tags(self, end: int | None = None) -> DataFrame:
        end = end or time.time_ns()
        return lookups.tag_names(self.spans, end - DAY, end)

    def tag_values(self, name: str, end: int | None = None) -> DataFrame:
        end = end or time.time_ns()
        return lookups.tag_values(self.spans, name, end - DAY, end)

    # ------------------------------------------------------------ SQL

    def sql(self, text: str) -> tuple[str, DataFrame]:
        sql.register(self.spans, self.links)
        return sql.query(self.spark, text)


def to_prometheus(kind: str, plan: DataFrame, max_series: int = MAX_SERIES, max_points: int = MAX_POINTS) -> dict:
    """Collected result in JSON form; values as texts of at most 15 digits, times in seconds."""
    value = lambda v: f"{v:.15g}"
    if kind == "scalar":
        r = plan.first()
        return {"resultType": "scalar", "result": [r.time_ns / scalar.SECOND, value(r.value)]}
    if kind == "vector":
        rows = plan.orderBy("series").limit(max_series + 1).collect()
        out = {"resultType": "vector", "result": [{"metric": _metric(r.series), "value": [r.time_ns / scalar.SECOND, value(r.value)]} for r in rows[:max_series]]}
        return out | ({"limited": True} if len(rows) > max_series else {})
    # points one row each, so no series is ever one row
    rows = plan.select("labels", "time_ns", "value").orderBy("labels", "time_ns").limit(max_points + 1).collect()
    result: list[dict] = []
    last = None
    for r in rows[:max_points]:
        if r.labels != last:
            if len(result) == max_series:
                break
            result.append({"metric": {e.key: e.value for e in r.labels}, "values": []})
            last = r.labels
        result[-1]["values"].append([r.time_ns / scalar.SECOND, value(r.value)])
    whole = sum(len(x["values"]) for x in result) == len(rows)
    return {"resultType": "matrix", "result": result} | ({} if whole else {"limited": True})


def _metric(text: str) -> dict[str, str]:
    return dict(p.split("=", 1) for p in text.split(",") if "=" in p)


def to_json(envelope: dict) -> str:
    return json.dumps(envelope, separators=(",", ":"))
