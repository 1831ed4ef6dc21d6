"""Table schemas and generated columns.  Times are BIGINT nanoseconds, ids fixed-width lower-case hex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import scalar

TAGS = T.MapType(T.StringType(), T.StringType())

SPANS = T.StructType([
    T.StructField("trace_id", T.StringType(), False),
    T.StructField("span_id", T.StringType(), False),
    T.StructField("parent_span_id", T.StringType()),
    T.StructField("name", T.StringType(), False),
    T.StructField("start_time", T.LongType(), False),
    T.StructField("end_time", T.LongType(), False),
    T.StructField("duration", T.LongType(), False),
    T.StructField("service_name", T.StringType(), False),
    T.StructField("tags", TAGS),
])

LINKS = T.StructType([
    T.StructField("span_id", T.StringType(), False),
    T.StructField("linked_trace_id", T.StringType(), False),
    T.StructField("linked_span_id", T.StringType(), False),
    T.StructField("attributes", TAGS),
])

MANIFEST = T.StructType([
    T.StructField("block", T.StringType(), False),
    T.StructField("path", T.StringType()),
    T.StructField("min_time", T.LongType()),
    T.StructField("max_time", T.LongType()),
    T.StructField("span_count", T.LongType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("commit_seq", T.LongType()),
    T.StructField("min_segment", T.LongType()),
    T.StructField("max_segment", T.LongType()),
    T.StructField("created_at", T.LongType()),
    T.StructField("sources", T.ArrayType(T.StringType())),
])


def normalized(spans: DataFrame) -> DataFrame:
    """Spans with padded ids, null instead of an empty or zero parent, a derived duration where it is 0, and the
    generated columns bucket1s and duration_bucket."""
    parent = F.nullif(F.nullif(F.lpad(F.lower("parent_span_id"), 16, "0"), F.lit("0" * 16)), F.lit(""))
    out = spans.withColumns({
        "trace_id": F.lpad(F.lower("trace_id"), 32, "0"),
        "span_id": F.lpad(F.lower("span_id"), 16, "0"),
        "parent_span_id": F.when(F.col("parent_span_id") != "", parent),
        "duration": F.when(F.col("duration") != 0, F.col("duration")).otherwise(F.col("end_time") - F.col("start_time")),
    })
    return with_generated(out)


def with_generated(spans: DataFrame) -> DataFrame:
    return spans.withColumns({"bucket1s": scalar.bucket1s(F.col("start_time")), "duration_bucket": scalar.duration_bucket(F.col("duration"))})
