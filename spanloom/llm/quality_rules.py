r"""Quality rules with cross-document line frequency, in DataFrame operations only.

Base rules look at one text: words, symbols, repeated lines, repeated 3-word windows.  The cross-document
rule hashes normalised lines (lower case, trimmed of white space), counts for each host the distinct documents
(distinct ids) that hold a line, takes lines above ``max_docs`` as boilerplate, removes them, and rejects documents of which less than ``min_left`` of the
words is left.

A document brings each of its lines once, and counts are summed in each map task before the shuffle, so a hot host or a line that a third of all
documents hold is one row of each map task.  Lines above the limit
are few by nature (a host has at most its words / max_docs of them): they are counted, and broadcast up to ``MAX_BROADCAST_LINES``.

Defined cases: null text has no words and fails the base rules; null hosts are one host; rows of one id in one host are one document in the count, and rows with null
ids too; repeated rows get the same verdict; a document of ``max_docs`` exactly is not above the limit; a text of any length is one row, its 3-word windows are sorted as one array with their full
64-bit hashes; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_DOCS = 20
MIN_LEFT = 0.5
MIN_WORDS = 50
SYMBOLS = r"[#*$%&|<>]"
#: Hashes of frequent lines up to which they are broadcast (16 MB).
MAX_BROADCAST_LINES = 1_000_000
_SPLIT = r"'[\\x20\\x09-\\x0D]+'"
_A_WORD = r"'[^\\x20\\x09-\\x0D]'"


def base_rules(docs: DataFrame, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, fp (hash of the text) and the base columns; ``keep`` adds input columns."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), *keep)
    d = d.withColumn("w", F.expr(f"filter(split(t, {_SPLIT}), x -> x != '')"))
    d = d.withColumns({
        "n_words": F.size("w").cast("long"),
        "ls": F.expr(rf"filter(split(t, '\\n'), x -> x rlike {_A_WORD})"),
    })
    # windows with equal hashes side by side, each group in order of place
    d = d.withColumn("g", F.expr("if(size(w) < 3, array(), array_sort(transform(sequence(1, greatest(size(w) - 2, 1)), i -> struct(xxhash64(w[i - 1], w[i], w[i + 1]) as h, i as i))))"))
    d = d.withColumn("q", F.expr("if(size(g) < 2, array(), filter(g, (x, j) -> (j > 0 and get(g, j - 1).h = x.h) or get(g, j + 1).h <=> x.h))"))
    d = d.withColumn("q", F.expr("sort_array(transform(q, x -> x.i))"))
    repeat = "if(size(q) = 0, 0L, 3L + aggregate(sequence(0, size(q) - 1), 0L, (n, j) -> n + if(j = 0, 0L, least(3L, cast(q[j] - q[j - 1] as bigint)))))"
    spaces = F.regexp_count("t", F.lit(common.SPACE))
    out = d.select(
        "doc_id", "host", F.xxhash64("host", "t").alias("fp"), *[c for c in keep], "n_words",
        (F.length("t") - spaces).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.expr(repeat).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


#: A line without white space at its ends, in lower case.
_NORMAL = r"lower(trim(BOTH ' \u0009\u000a\u000b\u000c\u000d' FROM {}))"


def _lines(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """doc_id, fp (of host and text), at (place of the line), line (hash of host and line), words: one row for each line with a word."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.xxhash64(F.col(host_col), t).alias("fp"), F.posexplode_outer(F.split(t, "\n")).alias("at", "l"))
    return d.select("doc_id", "fp", "at", F.xxhash64("host", F.expr(_NORMAL.format("l"))).alias("line"), common.n_words(F.col("l")).alias("words")).where("words > 0")


def _line_sets(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """doc_id, line (hash of host and line): each line with a word, once for each row of the document."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    one = rf"transform(filter(split(t, '\\n'), x -> x rlike {_A_WORD}), x -> xxhash64(host, lower(trim(BOTH ' \u0009\u000a\u000b\u000c\u000d' FROM x))))"
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), t.alias("t"))
    return d.select("doc_id", F.expr(f"array_distinct({one})").alias("lines")).select("doc_id", F.explode_outer("lines").alias("line")).where("line is not null")


def frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """line, n_docs of the lines (hashed with their host) in more than ``max_docs`` distinct documents of a host."""
    seen = _line_sets(docs, id_col, text_col, host_col)
    return seen.distinct().groupBy("line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)


def _bounded(lines: DataFrame, label: str) -> tuple[DataFrame, bool]:
    """The table written, and whether it is small enough to be broadcast."""
    lines, _ = common.saved(common.narrow(lines), label)
    return lines, lines.count() <= MAX_BROADCAST_LINES


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Base columns, n_removed_words (words in boilerplate lines) and kept, for each row."""
    cols = {"id_col": id_col, "text_col": text_col, "host_col": host_col}
    often, few = _bounded(frequent_lines(docs, max_docs, **cols).select("line"), "frequent-lines")
    hit = _lines(docs, **cols).join(F.broadcast(often) if few else often, "line", "left_semi").select("doc_id", "fp", "at", "words").distinct()  # repeated rows count once
    gone = hit.groupBy(F.col("doc_id").alias("d"), F.col("fp").alias("f")).agg(F.sum("words").alias("gone"))
    base = base_rules(docs, **cols)
    out = base.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("fp") == F.col("f")), "left")
    out = out.withColumn("n_removed_words", F.least(F.coalesce("gone", F.lit(0)), F.col("n_words")).cast("long"))
    left = F.col("n_words") - F.col("n_removed_words")
    kept = ~F.col("base_failed") & (left >= F.lit(min_left) * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", kept.alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
q AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, CAST(sum(least(3, coalesce(nxt - i, 3))) AS BIGINT) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM q) GROUP BY r),
l AS (SELECT r, doc_id, source, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT r, doc_id, source, unnest(string_split(t, chr(10))) AS l FROM d)),
ld AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM l WHERE n > 0 GROUP BY r),
k AS (SELECT r, doc_id, source, n, lower(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS k FROM l WHERE n > 0),
o AS (SELECT source, k FROM k GROUP BY ALL HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) > 20),
gone AS (SELECT r, CAST(sum(n) AS BIGINT) AS n FROM k JOIN o ON k.source IS NOT DISTINCT FROM o.source AND k.k = o.k GROUP BY r),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(ld.n, 0) AS BIGINT) AS n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed_words
      FROM d JOIN w USING (r) LEFT JOIN ld USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 0.5 * n_words AS kept FROM b
"""
