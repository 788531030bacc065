"""``df.write.format("version_log").mode("append").save(path)``: appends that count as a whole or not at all.

A task attempt writes its rows to a file of its own under ``staging``. Once all tasks are
done, the files of the attempts that succeeded move to ``data/job=<id>``, and the commit
claims the next number by creating ``log/<number>.json``, which no two writers can create.
Readers see the jobs that have a number and nothing else, so a writer that fails, or is
killed at any point, leaves no row. Two that append at once get two numbers.

A version is a key's own count: its commits, in the order of their numbers.

As a streaming sink, give the stream a name in the option ``stream``: a batch that is
committed again after a failure is dropped.

The number is claimed by a hard link on a local file system and by a rename on HDFS, both of
which fail if the name exists; other stores are refused.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from siteloom.storage import exists

LOG = "commit long, job string, stream string, batch long, rows long, at double"


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))


def _names(store, folder: str) -> list:
    from pyarrow import fs

    return store.get_file_info(fs.FileSelector(folder, allow_not_found=True))


def claim(store, made: str, name: str) -> bool:
    """Give the file ``made`` the name ``name``, unless that exists."""
    if store.type_name == "local":
        try:
            os.link(made, name)
        except FileExistsError:
            return False
        store.delete_file(made)
        return True
    try:
        store.move(made, name)
    except OSError:
        from pyarrow import fs

        if store.get_file_info(name).type == fs.FileType.NotFound:
            raise
        return False
    return True


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class _Job:
    """What batch and streaming writers share. ``job`` is one transaction."""

    def __init__(self, options: dict) -> None:
        if "path" not in options:
            raise ValueError("version_log needs a path")
        self.path, self.stream = options["path"], options.get("stream")
        self.run = uuid.uuid4().hex
        store, _ = _opened(self.path)
        if store.type_name not in ("local", "hdfs"):
            raise ValueError(f"a {store.type_name} store cannot tell which of two writers was first")

    def _write(self, iterator: Iterator, job: str) -> Written:
        import pyarrow.parquet as pq

        store, root = _opened(self.path)
        name = f"{root}/staging/{job}/part-{uuid.uuid4().hex}.parquet"
        rows, writer = 0, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if writer is None:
                    store.create_dir(f"{root}/staging/{job}", recursive=True)
                    writer = pq.ParquetWriter(name, batch.schema, filesystem=store)
                writer.write_batch(batch)
                rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return Written(name if rows else "", rows)

    def _commit(self, messages: list, job: str, batch: int | None = None) -> int:
        store, root = _opened(self.path)
        store.create_dir(f"{root}/log", recursive=True)
        if batch is not None and any(e.get("stream") == self.stream and e.get("batch") == batch for e in entries(self.path)):
            self._abort(messages, job)
            return -1
        done = [m for m in messages if m and m.file]
        for m in done:
            store.create_dir(f"{root}/data/job={job}", recursive=True)
            store.move(m.file, f"{root}/data/job={job}/{m.file.rsplit('/', 1)[1]}")
        self._abort([], job)
        made = f"{root}/log/_{job}"
        number = max([n for n, _ in _numbered(store, root)], default=0)
        while True:
            number += 1
            entry = {"commit": number, "job": job, "rows": sum(m.rows for m in done), "at": time.time()} | ({"stream": self.stream, "batch": batch} if batch is not None else {})
            with store.open_output_stream(made) as out:
                out.write(json.dumps(entry).encode())
            if claim(store, made, f"{root}/log/{number:012d}.json"):
                return number

    def _abort(self, messages: list, job: str) -> None:
        from pyarrow import fs

        store, root = _opened(self.path)
        for m in messages:
            if m and m.file and store.get_file_info(m.file).type != fs.FileType.NotFound:
                store.delete_file(m.file)
        if store.get_file_info(f"{root}/staging/{job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/staging/{job}")


class _BatchWriter(_Job, DataSourceArrowWriter):
    def write(self, iterator: Iterator) -> Written:
        return self._write(iterator, self.run)

    def commit(self, messages: list) -> None:
        self._commit(messages, self.run)

    def abort(self, messages: list) -> None:
        self._abort(messages, self.run)


class _StreamWriter(_Job, DataSourceStreamArrowWriter):
    """Tasks do not know their batch, so they stage under the run's name, and a commit takes the files of its messages out of it."""

    def write(self, iterator: Iterator) -> Written:
        return self._write(iterator, self.run)

    def commit(self, messages: list, batchId: int) -> None:
        self._commit(messages, f"{self.run}-{batchId}", batchId)

    def abort(self, messages: list, batchId: int) -> None:
        self._abort(messages, f"{self.run}-{batchId}")


class VersionLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "version_log"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("version_log only appends")
        return _BatchWriter(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        if "stream" not in self.options:
            raise ValueError("a stream into a version_log needs a name: option('stream', ...)")
        return _StreamWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VersionLog)


def append(df: DataFrame, path: str) -> None:
    """Append ``df`` as one transaction, from any thread: data sources of Python are looked up in the thread's session."""
    spark = df.sparkSession
    register(spark)
    spark._jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(spark._jsparkSession)
    df.write.format(VersionLog.name()).mode("append").save(path)


def _numbered(store, root: str) -> list[tuple[int, str]]:
    return sorted((int(f.base_name[:-5]), f.path) for f in _names(store, f"{root}/log") if f.base_name.endswith(".json") and f.base_name[:-5].isdigit())


def entries(path: str) -> list[dict]:
    """The log, for the driver: a line a commit."""
    store, root = _opened(path)
    return [json.loads(store.open_input_stream(name).read()) for _, name in _numbered(store, root)]


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of commits, with ``commit``; files of other jobs are pruned by their folder."""
    if not exists(spark, f"{path}/log") or not exists(spark, f"{path}/data"):
        return spark.createDataFrame([], f"{schema}, commit long")
    log = spark.read.schema(LOG).option("pathGlobFilter", "*.json").json(f"{path}/log").select("job", "commit")
    rows = spark.read.schema(f"{schema}, job string").option("basePath", f"{path}/data").parquet(f"{path}/data")
    return rows.join(log, "job").drop("job")


def with_versions(rows: DataFrame, key: str = "site") -> DataFrame:
    """Rows of :func:`committed` with ``version``: the key's commits counted from one."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("commit")).cast("long")
    return rows.join(rows.select(key, "commit").distinct().withColumn("version", n), [key, "commit"]).drop("commit")


def latest(rows: DataFrame, key: str = "site") -> DataFrame:
    """Of each key the rows of its last commit, without counting the others."""
    return rows.join(rows.groupBy(key).agg(F.max("commit").alias("commit")), [key, "commit"], "left_semi")


def vacuum(path: str, older_than_s: float = 86_400) -> int:
    """Delete what writers that were killed have left behind for so long; how many jobs that was."""
    store, root = _opened(path)
    known = {e["job"] for e in entries(path)}
    old = [f for kind in ("staging", "data") for f in _names(store, f"{root}/{kind}") if f.base_name.removeprefix("job=") not in known and time.time() - f.mtime.timestamp() >= older_than_s]
    for f in old:
        store.delete_dir(f.path)
    return len(old)
