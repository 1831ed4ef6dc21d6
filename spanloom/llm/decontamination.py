r"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A mask keeps some of the next few token positions and ignores the rest, so a substituted token at an ignored position
does not change the hash.  Every position of every document and of every benchmark item is hashed under
each mask; equal hashes are hits.  A hit fixes an alignment (document place minus item place); around it the
aligned tokens are compared one by one, and a document is contaminated if some stretch of ``STRETCH``
aligned tokens (the whole item, if shorter) agrees in at least ``AGREE`` of its places.

Tokens are words, lower case, without leading and trailing punctuation.  The masks hit whatever the comparison accepts: ``MASKS`` every
pattern of up to four substitutions in 15 or 16 tokens, ``SHORT_MASKS`` every accepted pattern of an item of 7 to 14.  Items of fewer
tokens are found where a document holds them whole.  Documents are hashed under the masks that some item needs.

The documents' hashes never leave their task if the items' hashes are few enough to be broadcast (counted first); otherwise
both sides are shuffled by hash.  Aligned tokens are cut out of a document before items are joined to them, so a phrase that a document
repeats costs its own length each time, not the document's.

Defined cases: null or empty texts and items match nothing; items without tokens match
nothing; repeated rows of a document count once; repeated items give a row each id; a null id is an id like any other; of equally good stretches the
smallest shift is reported; extra columns, whatever their names, are ignored; a long text is one array; an empty table on either side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MASKS = ((0, 1, 2, 4), (0, 3, 4, 5))
STRETCH = 16
#: Items of fewer tokens have masks of their own.
LONG = 15
SHORT_MASKS = ((0, 1, 3), (0, 1, 2))
#: Items of fewer tokens must stand whole in a document.
SHORT = 7
AGREE = 0.7
#: Rows of item hashes, or of hit documents, up to which they are broadcast: at most 64 MB and 32 MB.
MAX_BROADCAST_ROWS = 1_000_000


def _tokens(text: str) -> Column:
    """Hashes of the tokens of a text column."""
    cut = rf"split(lower(`{text}`), '[\\x20\\x09-\\x0D]+')"
    return F.expr(rf"transform(filter({cut}, x -> x != ''), x -> xxhash64(trim(BOTH '.,;:!?()[]\"' FROM x)))")


def _ranges(masks) -> list[tuple[tuple[int, ...], int, int]]:
    """(mask, least and most tokens of the items under it); items count as ``STRETCH`` tokens at most."""
    whole = [(tuple(range(n)), n, n) for n in range(1, SHORT)]
    return [*((m, LONG, STRETCH) for m in masks), *((m, SHORT, LONG - 1) for m in SHORT_MASKS), *whole]


def _seeded(d: DataFrame, tokens: str, ranges, of_items: bool) -> DataFrame:
    """Columns ``pos``, ``seed`` and ``n`` in place of a token array: hashes of all places under the first mask, then under the second..."""
    n, arrays = f"size({tokens})", []
    for mask, low, high in ranges:
        picked = ", ".join(f"{tokens}[i + {o}]" if o else f"{tokens}[i]" for o in mask)
        fits = f"{n} > {mask[-1]}" + (f" and least({n}, {STRETCH}) between {low} and {high}" if of_items else "")
        arrays.append(f"if({fits}, transform(sequence(0, greatest({n} - {mask[-1] + 1}, 0)), i -> xxhash64({picked})), cast(array() as array<bigint>))")
    own = [c for c in d.columns if c != tokens]
    d = d.select(*own, F.expr(n).alias("n"), F.expr(f"concat({', '.join(arrays)})").alias("__seeds"))
    # nothing but numbers stands beside the array while it is exploded; not posexplode, for which Spark would compute the array twice
    return d.select(*own, "n", F.posexplode_outer("__seeds").alias("pos", "seed")).where("seed is not null")


def _place(ranges, of_items: bool) -> Column:
    """The place of a ``pos`` among the hashes of ``n`` tokens."""
    upto, cases = "0", []
    for mask, low, high in ranges:
        many = f"greatest(n - {mask[-1]}, 0)"
        if of_items:
            many = f"if(least(n, {STRETCH}) between {low} and {high}, {many}, 0)"
        cases.append(f"when pos < {upto} + {many} then pos - ({upto})")
        upto = f"{upto} + {many}"
    return F.expr(f"case {' '.join(cases)} end")


def _sides(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_key, a) and (item_key, b): token hashes of documents and items."""
    d = docs.select(F.col(id_col).alias("doc_key"), F.col(text_col).cast("string").alias("t")).where("t is not null").select("doc_key", _tokens("t").alias("a"))
    b = items.select(F.col(item_col).alias("item_key"), F.col(item_text_col).cast("string").alias("t")).distinct().where("t is not null").select("item_key", _tokens("t").alias("b"))
    return d, b


def _verified(x: DataFrame, stretch: int, agree: float) -> DataFrame:
    """doc_key, item_key, shift, n_tokens, n_equal: the best of the alignments (doc_key, item_key, shift, w, b) of each pair, if a stretch of it agrees;
    ``w`` are the document's tokens that stand against ``b``, null where the document has none."""
    x = x.withColumn("m", F.expr("zip_with(w, b, (p, q) -> if(p <=> q, 1, 0))")).withColumn("n", F.least(F.size("m"), F.lit(stretch)))
    x = x.withColumn("e", F.expr("array_max(transform(sequence(1, size(m) - n + 1), i -> aggregate(slice(m, i, n), 0, (s, v) -> s + v)))"))
    best = x.groupBy("doc_key", "item_key").agg(F.max(F.struct(F.col("e").alias("n_equal"), (-F.col("shift")).alias("back"), F.col("n").alias("n_tokens"))).alias("z"))
    return best.select("doc_key", "item_key", (-F.col("z.back")).alias("shift"), F.col("z.n_tokens"), F.col("z.n_equal")).where(F.col("n_equal") >= F.lit(agree) * F.col("n_tokens"))


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", stretch: int = STRETCH, agree: float = AGREE, masks=MASKS) -> DataFrame:
    """doc_key, item_key, shift, n_tokens (of the stretch), n_equal: the best verified stretch of each pair."""
    d, b = _sides(docs, items, id_col, text_col, item_col, item_text_col)
    b, _ = common.saved(common.narrow(b.where("size(b) > 0")), "items")
    sizes = [n for (n,) in b.select(F.least(F.size("b"), F.lit(STRETCH))).distinct().collect()]  # 16 at most
    ranges = [(m, low, high) for m, low, high in _ranges(masks) if not sizes or any(low <= n <= high for n in sizes)]
    seeds = _seeded(b, "b", ranges, True).select("seed", "item_key", _place(ranges, True).alias("item_place"), F.col("n").alias("size"))
    seeds, _ = common.saved(common.narrow(seeds), "item-seeds")
    hit = _seeded(d, "a", ranges, False).join(F.broadcast(seeds) if seeds.count() <= MAX_BROADCAST_ROWS else seeds, "seed")
    hit = hit.select(F.col("doc_key").alias("h_key"), "item_key", (_place(ranges, False) - F.col("item_place")).alias("shift"), "size").distinct()
    hit, _ = common.saved(common.narrow(hit), "seed-hits")
    few = hit.count() <= MAX_BROADCAST_ROWS
    # hit documents first, then their tokens
    keys = hit.select(F.col("h_key").alias("k")).distinct()
    own = docs.join(F.broadcast(keys) if few else keys, docs[id_col].eqNullSafe(F.col("k")), "left_semi")
    own, _ = _sides(own, items, id_col, text_col, item_col, item_text_col)
    x = own.join(F.broadcast(hit) if few else hit, F.col("doc_key").eqNullSafe(F.col("h_key")))
    x = x.select("doc_key", F.col("item_key").alias("i_key"), "shift", F.expr("transform(sequence(0, size - 1), j -> get(a, j + shift))").alias("w"))
    x = x.join(b, F.col("i_key").eqNullSafe(F.col("item_key")))
    return _verified(x, stretch, agree)


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """Rows of ``docs`` without those of contaminated documents."""
    return common.without(docs, overlaps(docs, items, id_col=id_col, **columns).select("doc_key"), id_col)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = overlaps(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return got.select(F.col("doc_key").alias("doc_id"), F.col("item_key").alias("item_id"), "shift", "n_tokens", "n_equal")


#: Without seeds: an accepted stretch of 16 tokens has three equal tokens in a row, one of 7 to 15 has two, a shorter item is whole;
#: every alignment with as many in a row is compared.
OP2_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, list_transform(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+'), lambda x: trim(x, '.,;:!?()[]"')) AS a FROM documents),
b AS (SELECT item_id, b, CASE WHEN len(b) >= 16 THEN 3 WHEN len(b) >= 7 THEN 2 ELSE 1 END AS k
  FROM (SELECT DISTINCT item_id, list_transform(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+'), lambda x: trim(x, '.,;:!?()[]"')) AS b FROM benchmark)),
dp AS (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM d),
ds AS (SELECT doc_id, a, i, k, a[i : i + k - 1] AS s FROM dp, (SELECT DISTINCT k FROM b) WHERE i + k - 1 <= len(a)),
bs AS (SELECT item_id, b, k, j, b[j : j + k - 1] AS s FROM (SELECT item_id, b, k, unnest(range(1, len(b) + 1)) AS j FROM b) WHERE j + k - 1 <= len(b)),
h AS (SELECT DISTINCT doc_id, a, item_id, b, i - j AS shift FROM ds JOIN bs USING (k, s)),
x AS (SELECT doc_id, item_id, shift, len(b) AS l, list_transform(range(1, len(b) + 1), lambda j: CASE WHEN j + shift BETWEEN 1 AND len(a) AND a[j + shift] = b[j] THEN 1 ELSE 0 END) AS m FROM h),
y AS (SELECT doc_id, item_id, shift, l, least(l, 16) AS n, list_max(list_transform(range(1, CAST(l - least(l, 16) + 2 AS BIGINT)), lambda i: list_sum(m[i : i + least(l, 16) - 1]))) AS e FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY e DESC, shift) AS r FROM y WHERE e >= CASE WHEN l < 7 THEN n ELSE 0.7 * n END)
SELECT doc_id, item_id, CAST(shift AS INT) AS shift, CAST(n AS INT) AS n_tokens, CAST(e AS INT) AS n_equal FROM z WHERE r = 1
"""
