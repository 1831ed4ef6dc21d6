"""Tables between two passes, in the folder that all machines of a cluster share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode, where none is set, one of our own that goes with the process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spanloom-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return "file://" + _own[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def saved(d: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write a table as Parquet and read it back: its lineage ends there, so a later loss of executors costs only tasks."""
    path = new_path(d.sparkSession, label)
    d.write.parquet(path)
    return d.sparkSession.read.schema(d.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(hadoop).delete(p, True)
