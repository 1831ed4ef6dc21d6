"""Connected components of an edge table, by contraction to the smallest neighbour."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: So many edges (16 MB) are contracted by one task; of more, each round is a few tables.
ONE_TASK = 1 << 20


def components(edges: DataFrame) -> DataFrame:
    """(v, comp): the smallest vertex reachable from each vertex of ``edges`` (a, b).

    Each round maps every vertex to the smallest of itself and its neighbours and keeps the edges that still join
    two different images; a component of any shape at least halves.  Vertices, edges and labels stay in tables
    of the shared folder; the driver only sees how many edges are left.  Edges that one task can hold are contracted there,
    with the same result: each round here is some ten stages, whose plans and tasks the driver keeps in memory.
    """
    spark = edges.sparkSession
    e, e_path = common.saved(common.narrow(_ordered(edges)), "edges")
    label, label_path = None, None
    while left_edges := e.count():
        if left_edges <= ONE_TASK:
            solved, path = common.saved(e.coalesce(1).mapInArrow(_solved, "v long, comp long"), "labels")
            if label is not None:
                step = solved.select(F.col("v").alias("p"), F.col("comp").alias("q"))
                solved, path = common.saved(common.narrow(label.join(step, "p", "left").select("v", F.coalesce("q", "p").alias("comp"))), "labels")
                common.drop(spark, label_path)
            common.drop(spark, e_path)
            return solved
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("p"))
        if label is None:
            label, label_path = common.saved(common.narrow(parent), "labels")
        else:
            step = parent.select(F.col("v").alias("p"), F.col("p").alias("q"))
            moved, path = common.saved(common.narrow(label.join(step, "p", "left").select("v", F.coalesce("q", "p").alias("p"))), "labels")
            common.drop(spark, label_path)
            label, label_path = moved, path
        up = e.join(parent.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(parent.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        left, path = common.saved(common.narrow(_ordered(up.select(F.col("pa").alias("a"), F.col("pb").alias("b")))), "edges")
        common.drop(spark, e_path)
        e, e_path = left, path
    common.drop(spark, e_path)
    if label is None:
        return spark.createDataFrame([], "v long, comp long")
    return label.select("v", F.col("p").alias("comp"))


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, comp) of all edges of a task."""
    ends = [np.stack([np.asarray(b.column(0)), np.asarray(b.column(1))]) for b in batches]
    ids, at = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *ends], axis=1), return_inverse=True)
    x, y = at.reshape(2, -1)
    root = np.arange(len(ids))  # places follow ids, so the smallest place is the smallest id
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while ((up := root[root]) != root).any():
            root = up
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(ids[root], pa.int64())], names=["v", "comp"])
    del ends, at
    common.trim()
