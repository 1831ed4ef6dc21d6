"""Label matchers as predicates, and time predicates of spans."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import label
from ..functions.regex import java_regex

OPS = ("=", "!=", "=~", "!~")


@dataclass(frozen=True, order=True)
class Matcher:
    name: str
    op: str
    value: str

    def __post_init__(self):
        if self.op not in OPS:
            raise ValueError(f"invalid matcher op {self.op!r}")
        if self.op in ("=~", "!~"):
            java_regex(self.value)

    def __str__(self):
        return f'{self.name}{self.op}"{self.value.replace(chr(92), chr(92) * 2).replace(chr(34), chr(92) + chr(34))}"'


def predicate(m: Matcher) -> Column:
    """``=`` and ``=~`` need the label; ``!=`` and ``!~`` hold where it is absent."""
    x = label(m.name)
    if m.op == "=":
        return F.coalesce(x == m.value, F.lit(False)) if m.value == "" else x == m.value
    if m.op == "!=":
        return x.isNull() | (x != m.value)
    if m.op == "=~":
        return x.rlike(java_regex(m.value))
    return x.isNull() | ~x.rlike(java_regex(m.value))


def every(matchers: Iterable[Matcher]) -> Column:
    return reduce(lambda a, b: a & b, map(predicate, matchers), F.lit(True))


def overlaps(start: int, end: int) -> Column:
    """Spans that touch [start, end], both ends included."""
    return (F.col("end_time") >= start) & (F.col("start_time") <= end)


def contained(start: int, end: int) -> Column:
    """Spans that start in [start, end], both ends included."""
    return F.col("start_time").between(start, end)


def select(spans: DataFrame, matchers: Iterable[Matcher] = (), start: int | None = None, end: int | None = None) -> DataFrame:
    """The one scan: time and field predicates reach the Parquet reader, tags are read only where a matcher needs them."""
    if start is not None:
        spans = spans.where(F.col("end_time") >= start)
    if end is not None:
        spans = spans.where(F.col("start_time") <= end)
    ms = list(matchers)
    return spans.where(every(ms)) if ms else spans


def within_duration(spans: DataFrame, low: int = 0, high: int = 0) -> DataFrame:
    """low <= duration <= high, where 0 is no bound."""
    if low:
        spans = spans.where(F.col("duration") >= low)
    return spans.where(F.col("duration") <= high) if high else spans
