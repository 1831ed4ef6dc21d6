"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key.  Keys are split into equal ranges, so that one source spreads over
``BINS`` groups however large it is; sums of words by (source, range) are prefix-summed over the ranges
of a source, sorted keys inside a range finish the prefix sum.  A source's budget is cut exactly where its prefix
sum reaches it; budgets beyond the source's words repeat it in whole epochs first.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ...; the words of all
documents are shared by weight, no source gets more than ``max_repeat`` times its words, and what it
leaves goes to the others by weight until none is above.

Defined cases: null text has 0 words; null sources are one source; documents without words take 0
and are left out by :func:`mixed`; ties of the key (repeated rows) are ordered by id, then size, and share the budget in that order; empty
tables give no rows; other columns, whatever their names, are ignored by :func:`mix` and kept by :func:`mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

MAX_REPEAT = 3
#: Key ranges of a source: 16 ** BIN_DIGITS.
BIN_DIGITS = 4


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = MAX_REPEAT) -> DataFrame:
    """From (source, size): source, source_size, target.  One row a source is windowed, never one a document.

    With sources in order of cap / weight, those that reach their cap are a prefix of that order: the
    first source whose cap is not below the level shared by it and the rest ends the prefix.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = W.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(at) - 1) % len(weights) + 1).cast("int")).cast("long"))
    by = by.withColumn("cap", F.col("source_size") * max_repeat)
    rank = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = rank.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by = by.withColumns({
        "before": F.sum("cap").over(rank.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("cap"),
        "rest": F.sum("weight").over(rank.rowsBetween(W.currentRow, W.unboundedFollowing)),
        "total": F.sum("source_size").over(every),
    })
    level = (F.col("total") - F.col("before")) / F.col("rest")
    by = by.withColumn("level", F.min(F.when(level * F.col("weight") <= F.col("cap"), F.struct(F.col("before"), level.alias("level")))).over(every)["level"])
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return by.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _key(ident: Column) -> Column:
    return F.md5(F.coalesce(ident.cast("string"), F.lit("")).cast("binary"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeat: int = MAX_REPEAT, carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken; with ``carry`` the input row as struct ``row`` too."""
    d = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), common.n_words(F.col(text_col)).alias("size"), _key(F.col(id_col)).alias("key"),
        *([F.struct(*docs.columns).alias("row")] if carry else []),
    )
    if not carry:  # words are counted once; rows that are carried are not written a second time for it
        d, _ = common.saved(d, "sizes")
    d = d.withColumn("bin", F.substring("key", 1, BIN_DIGITS))
    bins = d.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    past = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = bins.withColumn("past", F.sum("bin_size").over(past) - F.col("bin_size"))
    goals = targets(bins.select("source", F.col("bin_size").alias("size")), max_repeat=max_repeat)
    plan = bins.alias("b").join(goals.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select(F.col("b.source").alias("p_source"), F.col("b.bin").alias("p_bin"), "past", "source_size", "target")
    own = W.partitionBy("source", "bin").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.withColumn("within", F.sum("size").over(own) - F.col("size"))
    d = d.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bin") == F.col("p_bin")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.expr("floor(target) div source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("past") - F.col("within")))
    taken = (epochs * F.col("size") + part).cast("long")
    return d.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), *(["row"] if carry else []))


def mixed(docs: DataFrame, **columns) -> DataFrame:
    """The mix itself: rows of ``docs``, repeated by epoch; the one document of a source on which its
    budget ends is cut after its last word taken.  Documents of which nothing is taken are left out."""
    text_col = columns.get("text_col", "text")
    d = mix(docs, carry=True, **columns).where("taken > 0")
    d = d.withColumn("whole", F.expr("taken div size")).withColumn("over", F.expr("taken % size"))
    copies = F.expr("transform(sequence(1L, whole + if(over > 0, 1L, 0L)), k -> if(k <= whole, -1L, over))")
    d = d.withColumn("words", F.explode(copies))
    text = F.col(f"row.{text_col}")
    # the boundary document keeps its first words: one document for each source, so splitting it is cheap
    kept = F.expr(f"array_join(slice(filter(split(row.`{text_col}`, '[ \\\\x09-\\\\x0D]+'), w -> w != ''), 1, cast(words as int)), ' ')")
    out = {c: F.col(f"row.`{c}`") for c in docs.columns}
    out[text_col] = F.when(F.col("words") < 0, text).otherwise(kept)
    return d.select(*(v.alias(k) for k, v in out.items()))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, CAST(sum(cap) OVER o AS BIGINT) - cap AS before, sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
         sum(source_size) OVER () AS total FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, CAST(total - before AS DOUBLE) / CAST(rest AS DOUBLE) AS level FROM r),
f AS (SELECT arg_min(level, before) AS level FROM l WHERE level * weight <= cap),
g AS (SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), f.level * weight), 0.0) AS target FROM w, f),
b AS (SELECT d.*, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN CAST(floor(g.target) AS BIGINT) // g.source_size ELSE 0 END AS epochs,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS past
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - past)) AS BIGINT) AS taken
FROM b
"""
