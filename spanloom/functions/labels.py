"""Labels of spans: top-level fields and tags under one naming, and canonical keys of label sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label names that are columns of a span; everything else is a tag.
FIELDS = {"trace_id": "trace_id", "span_id": "span_id", "parent_span_id": "parent_span_id", "name": "name", "service_name": "service_name", "service.name": "service_name"}
#: Tags that never become labels of a series.
_IDENTITY = ("trace_id", "span_id", "parent_span_id")


def label(name: str) -> Column:
    """Value of a label, null where a span does not have it (an empty field counts as absent)."""
    field = FIELDS.get(name)
    return F.nullif(F.col(field), F.lit("")) if field else F.col("tags")[F.lit(name)]


def _tags() -> Column:
    return F.coalesce(F.col("tags"), F.create_map().cast("map<string,string>"))


def _merged(low: Column, high: Column) -> Column:
    """Union of two maps, the second one wins; independent of the session's duplicate-key policy."""
    return F.map_concat(F.map_filter(low, lambda k, _: ~F.array_contains(F.map_keys(high), k)), high)


def metric_labels() -> Column:
    """Labels of a series of spans: tags without ids, the name as ``__name__`` and the service."""
    own = F.create_map(F.lit("__name__"), F.col("name"), F.lit("service_name"), F.col("service_name"))
    return _merged(F.map_filter(_tags(), lambda k, _: ~k.isin(*_IDENTITY)), own)


def all_labels() -> Column:
    """Every tag and the four fields that identify and name a span."""
    own = F.create_map(*(x for f in ("service_name", "name", "trace_id", "span_id") for x in (F.lit(f), F.col(f))))
    return _merged(_tags(), own)


def canonical(labels: Column) -> Column:
    """``k=v`` pairs in order of key, joined by commas.  For output only: grouping uses the columns or :func:`sorted_entries`."""
    return F.array_join(F.transform(sorted_entries(labels), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def sorted_entries(labels: Column) -> Column:
    return F.array_sort(F.map_entries(labels))


def by_key(keys: Sequence[str], columns: Sequence[str]) -> Column:
    """Canonical key of grouping columns; missing labels are left out, no labels at all give an empty text."""
    if not keys:
        return F.lit("")
    pairs = sorted(zip(keys, columns, strict=True))
    return F.concat_ws(",", *(F.concat(F.lit(f"{k}="), F.col(c)) for k, c in pairs))
