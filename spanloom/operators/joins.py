"""Joins on time that equality alone cannot express: the last row before, and points inside intervals.

Both cut time into cells of a width, so that a key with a third of all rows is many groups, and no pair is made that
is not in a common cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import step_index


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], value: str, into: str, time: str = "start_time", width: int = 3_600_000_000_000) -> DataFrame:
    """Rows of ``left`` with column ``into``: ``value`` of the last row of ``right`` with equal ``by`` and a time no later; null if there is none.
    Of right rows at one time the largest value holds.

    Inside a cell of ``width`` one window over the union finds the row before; a table of the last row of each cell, windowed over cells, gives what
    a cell begins with.  That table has a row for each key and cell, not for each row.
    """
    by = list(by)
    cell = step_index(F.col(time), width)
    rows = F.struct(*left.columns).alias("__row")
    a = left.select(*by, F.col(time).alias("__t"), cell.alias("__cell"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__value"), rows)
    b = right.select(*by, F.col(time).alias("__t"), cell.alias("__cell"), F.lit(0).alias("__side"), F.col(value).alias("__value"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"))
    both = a.unionByName(b)
    within = W.partitionBy(*by, "__cell").orderBy("__t", "__side", "__value").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = both.withColumn("__own", F.last(F.when(F.col("__side") == 0, F.struct("__value")), ignorenulls=True).over(within)).where("__side = 1")
    last = both.groupBy(*by, "__cell").agg(F.max(F.when(F.col("__side") == 0, F.struct("__t", "__value"))).alias("__last"))
    before = W.partitionBy(*by).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    last = last.select(*by, "__cell", F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    on = [d[k].eqNullSafe(last[k]) for k in (*by, "__cell")]
    out = d.join(last, on, "left").select(d["__row"], F.when(d["__own"].isNotNull(), d["__own.__value"]).otherwise(last["__carried.__value"]).alias(into))
    return out.select("__row.*", into)


def during(points: DataFrame, intervals: DataFrame, by: Sequence[str] = (), time: str = "start_time", begin: str = "start_time", end: str = "end_time", width: int = 3_600_000_000_000) -> DataFrame:
    """(p, i): each row of ``points`` with each row of ``intervals`` of equal ``by`` with begin <= time <= end, as two structs.

    An interval is repeated for the cells it touches, a point is in one; they meet by cell and are compared there."""
    by = list(by)
    p = points.select(*by, step_index(F.col(time), width).alias("__cell"), F.col(time).alias("__t"), F.struct(*points.columns).alias("p"))
    i = intervals.select(*by, F.explode(F.sequence(step_index(F.col(begin), width), F.greatest(step_index(F.col(end), width), step_index(F.col(begin), width)))).alias("__cell"), F.col(begin).alias("__a"), F.col(end).alias("__b"), F.struct(*intervals.columns).alias("i"))
    return p.join(i, [*by, "__cell"]).where("__t between __a and __b").select("p", "i")
