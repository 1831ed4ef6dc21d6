"""Scalar functions as Column expressions (they stay inside code generation) and their parsing twins for the API edge."""

from __future__ import annotations

import re
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000_000
MAX_LONG = (1 << 63) - 1
#: Nanoseconds of the duration units of the language.
UNITS = {"s": SECOND, "m": 60 * SECOND, "h": 3600 * SECOND, "d": 86400 * SECOND, "w": 7 * 86400 * SECOND, "y": 365 * 86400 * SECOND}
#: Key prefixes of resource attributes.
RESOURCE_PREFIXES = ("service.", "telemetry.sdk.", "process.", "deployment.", "host.", "container.", "k8s.", "cloud.")
#: Names of OTLP span kinds and status codes by number.
SPAN_KINDS = ("unspecified", "internal", "server", "client", "producer", "consumer")
STATUS_CODES = ("unset", "ok", "error")


def duration_bucket(ns: Column) -> Column:
    """Whole part of the binary logarithm, exactly; 0 up to 1 ns."""
    return F.when(ns <= 0, F.lit(0)).otherwise(F.length(F.bin(ns)) - 1).cast("int")


def bucket1s(ns: Column) -> Column:
    return ns - ns % F.lit(SECOND)


def bucket_low(b: Column) -> Column:
    return F.when(b < 0, F.lit(0)).when(b >= 62, F.lit(1 << 62)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int"))).cast("long")


def bucket_high(b: Column) -> Column:
    return F.when(b < 0, F.lit(0)).when(b >= 62, F.lit(MAX_LONG)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), (b + 1).cast("int"))).cast("long")


def bucket_middle(b: Column) -> Column:
    """Middle of [2**b, 2**(b + 1)) in whole nanoseconds."""
    return F.when(b <= 0, F.lit(1)).otherwise(F.call_function("shiftleft", F.lit(3).cast("long"), (b - 1).cast("int"))).cast("long")


def _whole_units(ns: Column) -> Column:
    def cut(n: int, unit: str) -> Column:
        return F.concat(F.call_function("div", ns, F.lit(n)).cast("string"), F.lit(unit)) if n > 1 else F.concat(ns.cast("string"), F.lit(unit))

    return F.when(ns < 1000, cut(1, "ns")).when(ns < 1_000_000, cut(1000, "µs")).when(ns < SECOND, cut(1_000_000, "ms")).otherwise(cut(SECOND, "s"))


def duration_range(b: Column) -> Column:
    """Text of a duration bucket, such as 1ms-2ms."""
    return F.when((b < 0) | (b > 63), F.lit("invalid")).otherwise(F.concat(_whole_units(bucket_low(b)), F.lit("-"), _whole_units(bucket_high(b))))


def human_duration(ns: Column) -> Column:
    """Duration with two decimals in the largest fitting unit."""

    def cut(n: int, unit: str) -> Column:
        return F.concat(F.format_string("%.2f", ns / F.lit(float(n))), F.lit(unit))

    return F.when(ns < 1000, F.concat(ns.cast("string"), F.lit("ns"))).when(ns < 1_000_000, cut(1000, "µs")).when(ns < SECOND, cut(1_000_000, "ms")).otherwise(cut(SECOND, "s"))


def hex_id(n: Column, width: int = 16) -> Column:
    return F.lpad(F.lower(F.hex(n)), width, "0")


def id_number(text: Column) -> Column:
    """Unsigned value of a hex id (up to 64 bits)."""
    return F.conv(text, 16, 10).cast("decimal(20,0)")


def is_resource_attribute(key: Column) -> Column:
    return reduce(lambda a, b: a | b, (key.startswith(p) for p in RESOURCE_PREFIXES))


def typed_tag_type(value: Column) -> Column:
    """bool, int64, float64 or string, as a text is read back."""
    is_bool = value.isin("1", "t", "T", "TRUE", "true", "True", "0", "f", "F", "FALSE", "false", "False")
    is_int = value.rlike(r"\A[+-]?[0-9]+\z") & value.try_cast("bigint").isNotNull()
    is_float = value.contains(".") & value.rlike(r"\A[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z")
    return F.when(is_bool, "bool").when(is_int, "int64").when(is_float, "float64").otherwise("string")


def normalized_tag_name(name: Column) -> Column:
    """Tag name without a leading dot and one leading ``resource.`` or ``span.``."""
    bare = F.regexp_replace(name, r"\A\.", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\Aresource\.", ""), r"\Aspan\.", "")


def attribute_text(value: Column) -> Column:
    """An OTLP AnyValue struct as text; arrays, maps and bytes become the literals that stand for them (fixed values)."""
    return F.coalesce(
        value["stringValue"],
        value["boolValue"].cast("string"),
        value["intValue"].cast("string"),
        F.when(value["doubleValue"].isNotNull(), F.format_string("%f", value["doubleValue"])),
        F.when(value["arrayValue"].isNotNull(), F.lit("[array]")),
        F.when(value["kvlistValue"].isNotNull(), F.lit("[map]")),
        F.when(value["bytesValue"].isNotNull(), F.concat(F.lit("["), F.length(F.unbase64(value["bytesValue"])).cast("string"), F.lit(" bytes]"))),
        F.lit(""),
    )


def _named(code: Column, names: tuple[str, ...], prefix: str, other: str) -> Column:
    """Name of a code given as number or as enum text; null is code 0."""
    number = F.when(code.isNull(), F.lit(0)).otherwise(F.coalesce(code.try_cast("int"), F.lit(-1)))
    by_number = F.when(number.between(0, len(names) - 1), F.element_at(F.array(*map(F.lit, names)), F.when(number.between(0, len(names) - 1), number + 1).otherwise(1))).otherwise(other)
    by_name = F.lower(F.regexp_replace(code, prefix, ""))
    return F.when(by_name.isin(*names), by_name).otherwise(by_number)


def span_kind(code: Column) -> Column:
    return _named(code, SPAN_KINDS, "SPAN_KIND_", "unspecified")


def status_code(code: Column) -> Column:
    return _named(code, STATUS_CODES, "STATUS_CODE_", "unknown")


def step_index(t: Column, step: int) -> Column:
    """Floor of t / step, for negative numbers too."""
    return F.call_function("div", t - F.pmod(t, F.lit(step)), F.lit(step))


# ---------------------------------------------------------------- texts at the API edge

_DURATION = re.compile(r"(?:\d+[smhdwy])+")


def parse_duration(text: str) -> int:
    """Nanoseconds of ``5m``, ``1h30m``, ``1d12h``; milliseconds and fractions are not durations of the language."""
    if not _DURATION.fullmatch(text):
        raise ValueError(f"invalid duration {text!r}")
    return sum(int(n) * UNITS[u] for n, u in re.findall(r"(\d+)([smhdwy])", text))


def parse_time(text: str | int) -> int:
    """Nanoseconds of seconds (below 1e10), nanoseconds, or an RFC 3339 time."""
    try:
        n = int(text)
        return n * SECOND if abs(n) < 10_000_000_000 else n
    except ValueError:
        pass
    m = re.fullmatch(r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?(Z|[+-]\d\d:\d\d)", str(text))
    if not m:
        raise ValueError(f"invalid time {text!r}")
    whole = datetime.fromisoformat(m[1] + m[3].replace("Z", "+00:00")).astimezone(timezone.utc)
    return int(whole.timestamp()) * SECOND + int((m[2] or "0").ljust(9, "0"))


#: Longest range for each default step, in seconds.
_STEPS = ((300, 5), (1800, 15), (7200, 30), (21600, 60), (86400, 300), (604800, 900))


def default_step(range_ns: int) -> int:
    return next((s for most, s in _STEPS if range_ns <= most * SECOND), 3600) * SECOND


def default_rate_step(range_ns: int, lookback_ns: int) -> int:
    """15 s, at least a twentieth of the range and at most a quarter of the lookback."""
    step = max(15 * SECOND, range_ns // 20)
    return max(1, min(step, lookback_ns // 4)) if lookback_ns else step
