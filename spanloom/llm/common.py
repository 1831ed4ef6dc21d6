"""Shared pieces of the corpus operators: table access, shared-folder checkpoints, text words.

Every operator takes a DataFrame with named id/text columns, keeps only what it needs under
its own column names (so extra or clashing columns never matter) and writes intermediate
tables only below ``spark.checkpoint.dir``, which all executors of a cluster see.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import inspect
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
WORD_RE = re.compile(WORD)

_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only in local mode where none is set (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spanloom-"))
        atexit.register(shutil.rmtree, _own_dir[0], True)
    return "file://" + _own_dir[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


#: Of a table of numbers (links, labels) so many partitions go into one file.
NARROW = 32


def narrow(df: DataFrame, heavy: bool = False) -> DataFrame:
    """A table of few bytes a row in NARROW times fewer partitions than the session has; with ``heavy``, what makes the rows keeps all its tasks."""
    k = parts_for(df.sparkSession, 1 / NARROW)
    return df.repartition(k) if heavy else df.coalesce(k)


def saved(df: DataFrame, label: str, **options) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and a
    lost executor costs only the tasks that ran on it.  Returns the table and its path."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Ways to empty what operators remember in a Python worker from task to task.
caches: list = []


def trim(keep_caches: bool = False) -> None:
    """Give memory that a Python worker no longer uses back to the system; workers outlive their tasks and operators.
    An operator that remembers nothing itself drops what others have left in the worker."""
    if not keep_caches:
        for empty in caches:
            empty()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(f: Callable) -> Callable:
    """A function of groups (one, two or three arguments) behind which the worker's memory goes back."""

    def run(*args):
        out = f(*args)
        trim()  # what f held is free by now
        return out

    n = len(inspect.signature(f).parameters)  # Spark counts named arguments
    return (lambda rows: run(rows)) if n == 1 else (lambda key, rows: run(key, rows)) if n == 2 else (lambda key, rows, more: run(key, rows, more))


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove tables made by :func:`saved` that no plan reads any more."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(hadoop).delete(p, True)


def n_words(text: Column) -> Column:
    """Number of words of a text; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def parts_for(spark: SparkSession, factor: float = 1.0) -> int:
    """Partitions for a keyed exchange: the session's setting, scaled for lighter or heavier rows."""
    return max(1, round(int(spark.conf.get("spark.sql.shuffle.partitions")) * factor))


#: Bytes of text that a task holds at once, and bytes of text for each byte of a compressed table.
TASK_BYTES, UNPACKED = 256 << 20, 4


def text_parts(df: DataFrame) -> int:
    """Partitions for an exchange of whole texts: the session's setting, or more if a partition would hold over TASK_BYTES by the size of the input."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0  # Spark does not know the size of some sources
    return max(parts_for(df.sparkSession), -(-known * UNPACKED // TASK_BYTES))


#: Ids are broadcast up to this number (32 MB of longs); beyond it both sides are shuffled by id.
MAX_BROADCAST_IDS = 4_000_000


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id is not in the one-column table ``ids``; the column names of ``ids`` do not matter."""
    ids, _ = saved(narrow(ids.toDF("__gone").distinct()), "ids")
    few = ids.count() <= MAX_BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs[id_col].eqNullSafe(ids["__gone"]), "left_anti")
