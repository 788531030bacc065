"""A store of providers' replies: what was once answered is not asked again.

A question has a mark, the hash of the provider's name and of what it is asked. Questions
whose mark has a reply in the store are left out; the others are dealt over a few tasks that
ask one by one, within a rate, with retries, and write replies to the store every few
answers. A task that is tried again first reads what its earlier attempt has written, and a
run that was stopped leaves its replies to the next one. What fails is stored with its error
and asked again the next time.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.storage import exists

Provider = Callable[[pd.DataFrame], str]
STORED = "mark string, provider string, reply string, error string, tries int, asked_at timestamp"


class Busy(Exception):
    """What a provider raises that wants to be asked again after so many seconds."""

    def __init__(self, after: float) -> None:
        super().__init__(f"busy for {after} s")
        self.after = after


class Manners(NamedTuple):
    """How a provider is asked: by so many tasks, so often a minute in all (0: as fast as it answers), so many times, with growing waits; replies are stored after so many."""

    tasks: int = 8
    per_minute: float = 0
    tries: int = 3
    wait_s: float = 1.0
    flush: int = 16


class ReplyStore(NamedTuple):
    spark: SparkSession
    path: str

    def read(self) -> DataFrame:
        """Every stored answer and failure."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).option("recursiveFileLookup", "true").parquet(self.path)

    def replies(self, provider: str) -> DataFrame:
        """``(mark, reply, error)``: the last reply of each mark, or its last error while it has none."""
        mine = self.read().where(F.col("provider") == provider)
        last = F.max_by(F.struct("reply", "error"), F.struct(F.col("reply").isNotNull(), "asked_at"))
        return mine.groupBy("mark").agg(last.alias("x")).select("mark", "x.reply", "x.error")

    def compact(self) -> None:
        """One run's worth of files in place of many; not while a run writes."""
        old, made = f"{self.path}/run=", f"{self.path}/run=compact-{uuid.uuid4().hex}"
        fs = self.spark._jvm.org.apache.hadoop.fs
        at = fs.Path(self.path)
        store = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        before = [s.getPath() for s in store.listStatus(at) if s.isDirectory()]
        self.read().write.parquet(f"{self.path}/_compact")
        store.rename(fs.Path(f"{self.path}/_compact"), fs.Path(made))
        for path in before:
            if old.rsplit("/", 1)[1] in path.getName():
                store.delete(path, True)


def questions(batched: DataFrame, keys: tuple[str, ...], provider: str) -> DataFrame:
    """``(*keys, mark, question)``: each group of rows as sorted JSON, with its mark."""
    others = [c for c in batched.columns if c not in keys]
    rows = F.array_sort(F.collect_list(F.struct(*keys, *others)))
    asked = batched.groupBy(*keys).agg(F.to_json(rows, {"ignoreNullFields": "false"}).alias("question"))
    return asked.withColumn("mark", F.sha2(F.concat(F.lit(provider + "\n"), "question").cast("binary"), 256))


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))


def _answered(folder: str) -> set[str]:
    """Marks that an earlier attempt of this task has had answered."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, root = _opened(folder)
    files = [f.path for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if not f.base_name.startswith("_") and f.base_name.endswith(".parquet")]
    return {m for f in files for m, r in zip(*(pq.read_table(f, filesystem=store, columns=["mark", "reply"])[c].to_pylist() for c in ("mark", "reply")), strict=True) if r is not None}


def _stored(folder: str, rows: list[tuple]) -> None:
    """A file appears under its name once it is whole."""
    import pyarrow.parquet as pq

    store, root = _opened(folder)
    store.create_dir(root, recursive=True)
    name = uuid.uuid4().hex
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.timestamp("us", tz="UTC")]
    names = ["mark", "provider", "reply", "error", "tries", "asked_at"]
    pq.write_table(pa.table({n: pa.array(v, k) for n, k, v in zip(names, kinds, zip(*rows, strict=True), strict=True)}), f"{root}/_{name}", filesystem=store)
    store.move(f"{root}/_{name}", f"{root}/{name}.parquet")


def _asked(provider: Provider, question: str, manners: Manners) -> tuple[str | None, str | None, int]:
    """Reply or error, and how often it was asked."""
    rows = pd.DataFrame(json.loads(question))
    for n in range(1, manners.tries + 1):
        try:
            return provider(rows), None, n
        except Exception as e:  # whatever a provider raises is kept with the question
            error, pause = f"{type(e).__name__}: {e}", e.after if isinstance(e, Busy) else manners.wait_s * 2 ** (n - 1)
        if n < manners.tries:
            time.sleep(pause)
    return None, error, manners.tries


def ask_stored(asked: DataFrame, provider: Provider, name: str, store: ReplyStore, manners: Manners = Manners()) -> DataFrame:
    """``asked`` of :func:`questions` with ``reply`` and ``error`` for ``question``, from the store after the missing ones were asked."""
    known = store.replies(name).where("reply IS NOT NULL").select("mark")
    # By hash into a fixed number of tasks: a task that is tried again gets the same questions.
    missing = asked.select("mark", "question").dropDuplicates(["mark"]).join(known, "mark", "left_anti").repartition(manners.tasks, "mark")
    run = f"{store.path}/run={uuid.uuid4().hex}"
    pause = 60 * manners.tasks / manners.per_minute if manners.per_minute else 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = f"{run}/task={TaskContext.get().partitionId()}"
        done, held, n = _answered(folder), [], 0
        for batch in batches:
            for mark, question in zip(batch["mark"].to_pylist(), batch["question"].to_pylist(), strict=True):
                if mark in done:
                    continue
                began = time.monotonic()
                reply, error, tries = _asked(provider, question, manners)
                held.append((mark, name, reply, error, tries, datetime.now(UTC)))
                n += 1
                if len(held) >= manners.flush:
                    _stored(folder, held)
                    held = []
                time.sleep(max(0.0, pause - (time.monotonic() - began)))
        if held:
            _stored(folder, held)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    missing.mapInArrow(work, "n long").agg(F.sum("n")).collect()
    return asked.drop("question").join(store.replies(name), "mark", "left")
