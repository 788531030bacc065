"""Appends that meet, fail and repeat; buckets that an upsert leaves alone."""

import os
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siteloom.sinks import buckets, version_log
from siteloom.sinks.buckets import BucketTable

SCHEMA = "site string, content string"


def rows_of(spark, path):
    return sorted(tuple(r) for r in version_log.with_versions(version_log.committed(spark, path, SCHEMA)).collect())


def test_appends_that_meet_get_versions_of_their_own(spark, tmp_path):
    version_log.register(spark)
    path = str(tmp_path)
    made = [spark.createDataFrame([("a", f"a{i}"), (f"only{i}", "x")], SCHEMA) for i in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda df: version_log.append(df, path), made))
    found = rows_of(spark, path)
    assert [v for s, _, v in found if s == "a"] and sorted(v for s, _, v in found if s == "a") == [1, 2, 3, 4]
    assert sorted(c for s, c, _ in found if s == "a") == ["a0", "a1", "a2", "a3"] and {v for s, _, v in found if s != "a"} == {1}
    assert [e["commit"] for e in version_log.entries(path)] == [1, 2, 3, 4]
    last = version_log.latest(version_log.committed(spark, path, SCHEMA)).where("site = 'a'").collect()
    assert len(last) == 1 and last[0].commit == 4


def test_a_writer_that_fails_leaves_no_row(spark, tmp_path):
    version_log.register(spark)
    path = str(tmp_path)
    version_log.append(spark.createDataFrame([("a", "first")], SCHEMA), path)
    late = spark.range(40, numPartitions=4).select(F.lit("a").alias("site"), F.when(F.col("id") == 39, F.raise_error(F.lit("half way"))).otherwise("second").alias("content"))
    with pytest.raises(Exception, match="half way"):
        version_log.append(late, path)
    assert rows_of(spark, path) == [("a", "first", 1)]
    # What a driver leaves that is killed before its commit, and one that is killed inside.
    for kind in ("staging/dead", "data/job=dead"):
        os.makedirs(f"{path}/{kind}")
        spark.createDataFrame([("a", "ghost")], SCHEMA).toPandas().to_parquet(f"{path}/{kind}/part-x.parquet")
    assert rows_of(spark, path) == [("a", "first", 1)]
    version_log.append(spark.createDataFrame([("a", "third")], SCHEMA), path)
    assert rows_of(spark, path) == [("a", "first", 1), ("a", "third", 2)]
    assert version_log.vacuum(path, 3600) == 0 and version_log.vacuum(path, 0) >= 2
    assert rows_of(spark, path) == [("a", "first", 1), ("a", "third", 2)] and len(list(Path(path, "data").iterdir())) == 2


def test_empty_appends_and_other_modes(spark, tmp_path):
    version_log.register(spark)
    path = f"{tmp_path}/t"
    none = spark.createDataFrame([], SCHEMA)
    assert version_log.committed(spark, path, SCHEMA).count() == 0 and version_log.vacuum(path) == 0
    version_log.append(none, path)
    assert rows_of(spark, path) == [] and len(version_log.entries(path)) == 1
    with pytest.raises(Exception, match="only appends"):
        none.write.format("version_log").mode("overwrite").save(path)
    with pytest.raises(Exception, match="needs a name"):
        spark.readStream.format("rate").load().writeStream.format("version_log").option("path", path).option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination()


def test_streamed_batches_count_once(spark, tmp_path):
    version_log.register(spark)
    path = f"{tmp_path}/t"
    for i in range(3):
        spark.createDataFrame([("a", f"v{i}")], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run(state):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        writer = stream.writeStream.format("version_log").option("path", path).option("stream", "pages").option("checkpointLocation", f"{tmp_path}/{state}")
        writer.trigger(availableNow=True).start().awaitTermination()

    run("one")
    assert [v for *_, v in rows_of(spark, path)] == [1, 2, 3]
    run("one")
    run("lost")  # a stream that has lost its progress commits the same batches again
    assert len(rows_of(spark, path)) == 3 and not list(Path(path, "staging").glob("*/*"))


def files(path):
    return {str(f.relative_to(path)) for f in Path(path).rglob("*.parquet")}


def test_buckets_that_are_not_touched_keep_their_files(spark, tmp_path):
    table = BucketTable(spark, f"{tmp_path}/t", "site string, id long", buckets=8)
    first = spark.range(200).select(F.concat(F.lit("s"), F.col("id") % 40).alias("site"), "id")
    assert buckets.upsert(table, first, ["site", "id"]) == list(range(8))
    before = files(table.path)
    one = first.where("site = 's7'").select("site", (F.col("id") + 1000).alias("id"))
    touched = buckets.replace_keys(table, one)
    after = files(table.path)
    assert len(touched) == 1 and {f for f in before ^ after} == {f for f in before | after if f.startswith(f"bucket={touched[0]}/")}
    want = {tuple(r) for r in first.where("site <> 's7'").union(one).collect()}
    assert {tuple(r) for r in table.read().collect()} == want and table.read().count() == len(want)
    assert buckets.remove_keys(table, first.limit(0)) == [] and files(table.path) == after


def test_a_bucket_without_rows_goes(spark, tmp_path):
    table = BucketTable(spark, f"{tmp_path}/t", "site string, id long", buckets=4)
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "site string, id long")
    buckets.upsert(table, rows, ["site", "id"])
    buckets.remove_keys(table, rows.where("site = 'a'"))
    assert sorted(r.id for r in table.read().collect()) == [2, 3]
    buckets.remove_keys(table, rows.where("site = 'b'"))
    assert [r.id for r in table.read().collect()] == [3]


def test_a_rewrite_that_is_cut_off_is_finished_later(spark, tmp_path, monkeypatch):
    table = BucketTable(spark, f"{tmp_path}/t", "site string, id long", buckets=4)
    buckets.upsert(table, spark.createDataFrame([("a", 1), ("b", 1)], "site string, id long"), ["site"])
    real, calls = buckets.finish, []

    def cut(t):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("killed before the folders were replaced")
        return real(t)

    monkeypatch.setattr(buckets, "finish", cut)
    with pytest.raises(OSError, match="killed"):
        buckets.upsert(table, spark.createDataFrame([("a", 2)], "site string, id long"), ["site"])
    monkeypatch.undo()
    assert buckets.finish(table) and not buckets.finish(table)
    assert sorted(tuple(r) for r in table.read().collect()) == [("a", 2), ("b", 1)]
    Path(f"{table.path}.pending/rows").mkdir(parents=True)  # of a merge that never ended
    assert not buckets.finish(table) and not Path(f"{table.path}.pending").exists()
    assert sorted(tuple(r) for r in table.read().collect()) == [("a", 2), ("b", 1)]
