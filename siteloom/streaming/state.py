"""Keyed, time-driven state over event streams; each operator equals its batch twin."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siteloom.conf import CONF
from siteloom.storage import new_path


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Event files as a stream with an hour of lateness."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withWatermark("ts", "1 hour")


def _sorted(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["ts", "id"], kind="stable")


def backoff_stream(checks: DataFrame) -> DataFrame:
    """``(site, ts, id, hours)``: the interval after each check, from the interval held for its site.

    Within a trigger a site's checks go in order of time; state is one number a site.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hours = state.get[0] if state.exists else CONF.interval_hours
        found = _sorted(rows)
        out = []
        for changed in found["changed"]:
            hours = CONF.min_interval_hours if changed else min(2 * hours, CONF.max_interval_hours)
            out.append(hours)
        state.update((hours,))
        yield pd.DataFrame({"site": key[0], "ts": found["ts"], "id": found["id"], "hours": out})

    grouped = checks.select("site", "ts", "id", "changed").groupBy("site")
    return grouped.applyInPandasWithState(step, "site long, ts timestamp, id long, hours long", "hours long", "append", GroupStateTimeout.NoTimeout)


def cooldown_stream(triggers: DataFrame, hours: int = CONF.cooldown_hours) -> DataFrame:
    """``(site, ts, id, fired)``: a trigger fires unless one fired less than ``hours`` before.

    State is the end of the cooldown; a timer clears it once the watermark has passed it.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        found = _sorted(rows)
        out = []
        for ts in found["ts"]:
            fired = until is None or ts >= until
            if fired:
                until = ts + pd.Timedelta(hours=hours)
            out.append(fired)
        micros = int(until.value // 1000)
        state.update((micros,))
        if micros // 1000 > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(micros // 1000)
        yield pd.DataFrame({"site": key[0], "ts": found["ts"], "id": found["id"], "fired": out})

    grouped = triggers.select("site", "ts", "id").groupBy("site")
    return grouped.applyInPandasWithState(step, "site long, ts timestamp, id long, fired boolean", "until long", "append", GroupStateTimeout.EventTimeTimeout)


def progress_stream(events: DataFrame) -> DataFrame:
    """The latest event of each site, as an updating aggregate."""
    last = F.max(F.struct("ts", "id", "value"))
    return events.groupBy("site").agg(last.alias("x")).select("site", F.col("x.ts").alias("ts"), F.col("x.id").alias("id"), F.col("x.value").alias("value"))


def expiring_progress_stream(events: DataFrame, ttl: int = CONF.progress_ttl_seconds) -> DataFrame:
    """``(site, ts, id, kind)``: each site's latest event as it is ``set``, and as it has ``expired``.

    State is one event a site with a timer; once the watermark is ``ttl`` seconds past
    it, the state goes.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            micros, last = state.get
            state.remove()
            yield pd.DataFrame({"site": [key[0]], "ts": [pd.Timestamp(micros, unit="us")], "id": [last], "kind": ["expired"]})
            return
        found = _sorted(rows).iloc[-1]
        latest = (int(found["ts"].value // 1000), int(found["id"]))
        kept = max(latest, state.get) if state.exists else latest
        ends = kept[0] // 1000 + 1000 * ttl
        if ends <= state.getCurrentWatermarkMs():  # late, and over already
            if state.exists:
                state.remove()
            yield pd.DataFrame({"site": [key[0]], "ts": [pd.Timestamp(kept[0], unit="us")], "id": [kept[1]], "kind": ["expired"]})
            return
        state.update(kept)
        state.setTimeoutTimestamp(ends)
        if kept == latest:
            yield pd.DataFrame({"site": [key[0]], "ts": [pd.Timestamp(kept[0], unit="us")], "id": [kept[1]], "kind": ["set"]})

    grouped = events.select("site", "ts", "id").groupBy("site")
    return grouped.applyInPandasWithState(step, "site long, ts timestamp, id long, kind string", "ts long, id long", "append", GroupStateTimeout.EventTimeTimeout)


def monitor_stream(checks: DataFrame, window: str = "1 day") -> DataFrame:
    """Checks and changes by site and event-time window; late events within the watermark count."""
    found = checks.groupBy("site", F.window("ts", window).alias("w")).agg(F.count("*").alias("n_checks"), F.sum(F.col("changed").cast("long")).alias("n_changed"))
    return found.select("site", F.col("w.start").alias("day"), "n_checks", "n_changed")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which timers and typed state need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything a stream has now, as a table in the shared folder.

    An appending stream goes to a file sink; of one that gives its whole result with
    each trigger, the last result stays. Nothing is held by the driver.
    """
    spark = stream.sparkSession
    path, schema = new_path(spark, name), stream.schema
    writer = stream.writeStream.queryName(name).trigger(availableNow=True).option("checkpointLocation", new_path(spark, f"{name}-state"))
    if mode == "append":
        query = writer.outputMode(mode).format("parquet").start(path)
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(path)
