"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in local tests.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"


_caches: dict[str, Callable[[], None]] = {}


def keeps(owner: str, clear: Callable[[], None]) -> None:
    """Name the function that empties what an operator keeps in a Python worker between its tasks."""
    _caches[owner] = clear


_last: list[str] = []


def takes_over(owner: str) -> None:
    """Called by a task in its worker: what other operators left there goes, as workers outlive stages.

    At a change of operators, memory that is free goes back to the system too.
    """
    for name, clear in _caches.items():
        if name != owner:
            clear()
    if _last != [owner]:
        _last[:] = [owner]
        gc.collect()
        pa.default_memory_pool().release_unused()
        # glibc keeps what numpy has freed; other libraries have no such call
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share."""
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not top:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = LOCAL_CHECKPOINTS
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(top)
    return f"{top.rstrip('/')}/quillspark-{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again.

    Cuts the lineage: a lost executor costs the tasks that ran on it, not the
    stages before.  The commit protocol of Spark's writer keeps retried and
    speculative tasks from leaving rows twice.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    # shuffles that only this write read go once the driver's JVM has dropped them
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the tables of :func:`written` that ``df`` reads; nothing may read it any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for top in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if "/quillspark-" in top:
            path = jvm.org.apache.hadoop.fs.Path(top)
            path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the path may be any that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
