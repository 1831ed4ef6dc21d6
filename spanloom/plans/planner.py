"""From a syntax tree to a DataFrame plan; Catalyst does the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import series
from ..operators.matchers import Matcher, overlaps, select
from .language import EXTENSIONS, Aggregation, Call, LanguageError, Node, Number, Range, Selector, normalize, parse, result_type, validate


@dataclass(frozen=True)
class Options:
    """Evaluation range in nanoseconds; ``mode`` is documented or observed behaviour where the two differ."""

    start: int
    end: int
    step: int = 0
    limit: int | None = None
    mode: str = "documented"


def matchers_of(selector: Selector) -> list[Matcher]:
    """Matchers of a selector; a metric name stands for the service."""
    own = [Matcher("service_name", "=", selector.metric)] if selector.metric else []
    return own + list(selector.matchers)


class Planner:
    def __init__(self, spans: DataFrame, options: Options, seen: Observation | None = None):
        self.spans, self.o, self.seen, self.observed = spans, options, seen, False

    def scan(self, node: Selector | Range) -> DataFrame:
        """Spans of a selector in the evaluation range, counted by the first scan if somebody wants to know."""
        d = self._scan(node)
        if self.seen is None or self.observed:
            return d
        self.observed = True
        return d.observe(self.seen, F.count(F.lit(1)).alias("spans"))

    def _scan(self, node: Selector | Range) -> DataFrame:
        """Spans of a selector in the evaluation range; of a range selector also those of the lookback before it."""
        if isinstance(node, Range):
            back = scalar.parse_duration(node.length)
            d = select(self.spans, matchers_of(node.selector))
            if self.o.mode == "observed":  # nothing before start is fetched
                d = d.where(overlaps(self.o.start, self.o.end))
            return series.range_scan(d, self.o.start, self.o.end, back)
        return select(self.spans, matchers_of(node), self.o.start, self.o.end)

    def plan(self, node: Node) -> DataFrame:
        if isinstance(node, (Selector, Range)):
            return self.scan(node)
        if isinstance(node, Number):
            return self.spans.sparkSession.range(1).select(F.lit(node.value).alias("value"), F.lit(self.o.end).cast("long").alias("time_ns"))
        if isinstance(node, Call):
            return self.call(node)
        return self.aggregation(node)

    def call(self, node: Call) -> DataFrame:
        if node.name == "rate":
            back = scalar.parse_duration(node.args[0].length)
            step = self.o.step or scalar.default_rate_step(self.o.end - self.o.start, back)
            return series.rate(self.scan(node.args[0]), self.o.start, self.o.end, step, back)
        if node.name == "heatmap":
            return series.heatmap_matrix(self.scan(node.args[0]))
        if node.name == "histogram_quantile":
            if not isinstance(node.args[1], (Selector, Range)):
                raise LanguageError("histogram_quantile() needs spans: a selector or a range selector")
            return series.quantile(self.scan(node.args[1]), node.args[0].value, self.o.end)
        return EXTENSIONS[node.name][0](self, node.args)

    def aggregation(self, node: Aggregation) -> DataFrame:
        kind, keys = (node.grouping.kind, node.grouping.keys) if node.grouping else (None, ())
        inner = result_type(node.arg)
        if inner == "spans":
            d = self.scan(node.arg)
            if kind is None and self.o.mode == "observed":
                return series.aggregate_each(d, node.op, self.o.end)
            return series.aggregate_spans(d, node.op, kind, keys, self.o.end)
        if inner == "matrix":
            return series.aggregate_matrix(self.plan(node.arg), node.op, kind, keys)
        child = self.plan(node.arg)
        if "series" not in child.columns:
            child = child.withColumn("series", F.lit(""))
        # the series of a vector as labels again
        entries = F.transform(F.filter(F.split("series", ","), lambda s: s != ""), lambda s: F.struct(F.substring_index(s, "=", 1).alias("key"), F.regexp_replace(s, r"\A[^=]*=", "").alias("value")))
        return series.with_series(series.aggregate_matrix(child.withColumn("labels", entries), node.op, kind, keys)).select("series", "value", "time_ns")


def execute(spans: DataFrame, text: str, options: Options) -> tuple[str, DataFrame]:
    """Result type and plan of a text.  Spans and series are ordered before a limit, so limits are reproducible."""
    node = normalize(parse(text))
    validate(node)
    kind, d = result_type(node), Planner(spans, options).plan(node)
    if kind == "matrix":
        d = series.with_series(d)
    if options.limit:
        order = {"spans": ("start_time", "span_id"), "matrix": ("series", "time_ns"), "vector": ("series",)}.get(kind, ())
        d = d.orderBy(*order).limit(options.limit)
    return kind, d
