"""Quality classifier by compression.

Two zstandard dictionaries of equal size are built from good and from bad labelled texts.  A text is
compressed whole with each; ``(bad size - good size) / (bad size + good size)`` says which corpus it
resembles, and is all that a score knows of a text.  A logistic curve fitted on labelled texts that are in neither dictionary turns the
difference into a probability, for as many good as bad texts as the sample has (half each, where the labels allow it).

Fitting reads a bounded sample: per class the ``max_rows`` labelled rows with the smallest hash of their id, of
those with texts of at most ``max_chars`` characters, so the driver holds 2 * MAX_ROWS * MAX_CHARS characters (49 million) at most.  Scoring reads every
text whole; labels, language, source and id are never inputs of a score.

Defined cases: null and empty texts are scored as empty (difference 0), and a null text is not learned from; a text without labels is just
scored; null labels are not learned from, of several labels of one id the smallest holds; if a class has no training row, every score is the share of
good labels (0.5 without labels); repeated rows are scored each, equal texts alike; ties of the sample's order are broken by id; an empty table gives no rows; a text of any
length is compressed in memory of its own size; other columns pass through, a column named like the score is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LEVEL = 3
DICT_BYTES = 1 << 16
MAX_ROWS = 1500
MAX_CHARS = 1 << 14


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # of 1 and the difference

    def scorer(self):
        if not self.good:
            flat = 1 / (1 + math.exp(-self.weights[0]))
            return lambda text: flat
        sizes = [_sizer(self.good), _sizer(self.bad)]
        w = self.weights

        def score(text: str) -> float:
            z = float(np.dot(w, _features(text, *sizes)))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def _sizer(content: bytes):
    d = zstandard.ZstdCompressionDict(content)
    d.precompute_compress(level=LEVEL)
    c = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    return lambda raw: len(c.compress(raw))


def _features(text: str, good, bad) -> np.ndarray:
    raw = text.encode("utf-8", "surrogatepass")
    g, b = good(raw), bad(raw)
    return np.asarray([1.0, 10 * (b - g) / (b + g)])


def _dictionary(texts: list[str]) -> bytes:
    samples = [t.encode("utf-8", "surrogatepass") for t in texts]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to choose from: the text itself is the dictionary
        return b"\n".join(samples)[-DICT_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def fit_texts(good: list[str], bad: list[str]) -> Model:
    """Odd texts of each class build the dictionaries, even ones calibrate."""
    if not good or not bad:
        p = (len(good) + 0.5) / (len(good) + len(bad) + 1)
        return Model(b"", b"", (math.log(p / (1 - p)),))
    half = lambda x, k: x[k::2] or x
    g, b = _dictionary(half(good, 1)), _dictionary(half(bad, 1))
    sizes = [_sizer(g), _sizer(b)]
    held = [(t, 1) for t in half(good, 0)] + [(t, 0) for t in half(bad, 0)]
    x = np.asarray([_features(t, *sizes) for t, _ in held])
    return Model(g, b, _logistic(x, np.asarray([float(y) for _, y in held])))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train: Column | None = None, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    """Fit on at most ``max_rows`` labelled rows of each class; ``train`` says which rows may be used."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1))
    usable = ~held_out(F.col("doc_id")) if train is None else train
    marks = marks.where(usable).groupBy("doc_id").agg(F.min("y").alias("y"))
    fits = d.where(F.length("text") <= max_chars).select("doc_id").distinct().join(marks, "doc_id")
    order = (F.xxhash64(F.col("doc_id").cast("string")), "doc_id")
    chosen = fits.where("y = 1").orderBy(*order).limit(max_rows).union(fits.where("y = 0").orderBy(*order).limit(max_rows)).collect()
    y = {r.doc_id: r.y for r in chosen}
    if not y:
        return fit_texts([], [])
    rows = d.where(F.col("doc_id").isin(list(y))).groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).collect()
    rows.sort(key=lambda r: r.doc_id)
    texts = [(y[r.doc_id], r.t["text"] or "") for r in rows]
    return fit_texts([t for k, t in texts if k], [t for k, t in texts if not k])


def scored(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """All columns of ``docs`` and a double column ``into``; one row out for each row in.  The model
    (two dictionaries of DICT_BYTES each) travels with the task."""
    wanted = [c for c in docs.columns if c != into]
    own = text_col in wanted and isinstance(docs.schema[text_col].dataType, T.StringType)  # then the text is sent once
    out = docs.select(wanted) if own else docs.select(*wanted, F.col(text_col).cast("string").alias(common.free_name(docs, "__score_text")))
    at = wanted.index(text_col) if own else len(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):  # whole texts go back too: a few at a time
                b = batch.slice(k, 500)
                got = pa.array([score(t.as_py() or "") for t in b.column(at)], pa.float64())
                yield pa.RecordBatch.from_arrays([*b.columns[: len(wanted)], got], names=[*wanted, into])
        common.trim()

    schema = T.StructType([*(out.schema[c] for c in wanted), T.StructField(into, T.DoubleType())])
    return out.mapInArrow(run, schema)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    d = scored(docs, model)
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
