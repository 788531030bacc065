"""Shared storage, ordered bucketing and word rules of the ``llm`` operators."""

from __future__ import annotations

import gc
import tempfile
import threading
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session without the setting gets a temporary folder; a cluster
    without it is an error, because executors would write to their own disks.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="siteloom-"))
    return spark.conf.get("spark.checkpoint.dir")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/siteloom/{tag}-{uuid.uuid4().hex}"


class _Made(threading.local):
    """A thread's tables: ``paths`` of :func:`materialize` in their order, ``stored`` by stages that are over."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.stored: list[str] = []


MADE = _Made()


def sweep(spark: SparkSession, paths: list[str], reader: DataFrame) -> None:
    """Delete those tables of ``paths`` that ``reader`` does not read."""
    files = reader.inputFiles()
    for path in [p for p in paths if not any(p.rsplit("/", 1)[1] in f for f in files)]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        paths.remove(path)


def until_exit(spark: SparkSession, path: str) -> None:
    """Have the driver delete a folder of intermediate data when it ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def materialize(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder, in a folder for each value of ``by``, and read it back.

    Cuts the lineage: what reads the result survives lost executors without
    recomputing ``df``, and several consumers share one computation.
    """
    path = new_path(df.sparkSession, tag)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    until_exit(df.sparkSession, path)
    MADE.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: How the Python worker at hand gives back what tasks of other operators left in it.
CACHES: list[Callable[[], None]] = []


def forget() -> None:
    """Give back the memory of caches that earlier tasks of this Python worker filled."""
    for clear in CACHES:
        clear()
    pa.default_memory_pool().release_unused()


#: Seconds without use after which a Python worker gives back its caches; stages without Python need the memory.
IDLE_S = 8.0
_used = {"at": 0.0}


def in_use() -> None:
    """Called by what fills a cache: the worker keeps it while calls come."""
    if not _used["at"]:
        threading.Thread(target=_give_back, daemon=True).start()
    _used["at"] = time.monotonic()


def _give_back() -> None:
    while True:
        time.sleep(IDLE_S / 4)
        if _used["at"] and time.monotonic() - _used["at"] > IDLE_S:
            forget()
            gc.collect()
            _used["at"] = 0.0
            return


def release(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that nothing reads any more."""
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def cut_points(df: DataFrame, key: str, n: int) -> list:
    """At most ``n - 1`` ascending values that deal ``key`` into ``n`` ranges of like counts.

    One mergeable quantile sketch; the driver gets as many values as ranges.
    """
    if n < 2:
        return []
    shares = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(key, shares, 20 * n)).first()[0]
    return sorted(set(found or []))


def range_bucket(key: str, cuts: list, lo: int = 0, hi: int | None = None) -> Column:
    """Index of the range that holds ``key``, as a binary search in the plan; nulls get range 0."""
    hi = len(cuts) if hi is None else hi
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    higher = F.col(key) > F.lit(cuts[mid])
    return F.when(higher, range_bucket(key, cuts, mid + 1, hi)).otherwise(range_bucket(key, cuts, lo, mid))
