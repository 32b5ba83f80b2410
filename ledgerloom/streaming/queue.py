"""The queue as streams: deduplicated intake, batches of claims, leases with timers, fencing of late results."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir; in local mode, where that's unset, a temporary one."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/ledgerloom-stream/{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream, with the event time that watermarks need."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(folder)
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, keys: list[str], delay: str = "40 days") -> DataFrame:
    """The first event of each key; state is dropped behind the watermark."""
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Events of each type in tumbling windows of event time, late ones included up to the delay."""
    return events.withWatermark("at", delay).groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"))


LEASES = "user_id long, attempts long, fenced long"
_STATE = "until long, attempts long, fenced long"


def lease_outcomes(events: DataFrame, lease_seconds: int = 60, idle_seconds: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """Per job (here a user's events): attempts, and results fenced off because their lease had run out.

    A click or view takes or retakes the lease; any other event is a worker's result, which counts only under a lease.
    With ``idle_seconds`` the state of a job is dropped once the watermark is so far beyond its last event; an event
    that comes later counts from zero.  Without, counts are over all time and so is the state.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until, attempts, fenced = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        times = rows["at"].to_numpy().astype("datetime64[s]").astype("int64").tolist()
        for at, kind in zip(times, rows["event_type"], strict=True):
            if kind in ("click", "view"):
                if at > until:
                    attempts += 1
                until = at + lease_seconds
            elif at >= until:
                fenced += 1
            else:
                until = 0
        state.update((int(until), int(attempts), int(fenced)))
        if idle_seconds is not None:
            state.setTimeoutTimestamp(max((times[-1] + idle_seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "attempts": [attempts], "fenced": [fenced]})

    rows = events if idle_seconds is None else events.withWatermark("at", delay)
    timeout = GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.EventTimeTimeout
    rows = rows.select("user_id", "event_id", "at", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(step, LEASES, _STATE, "update", timeout)


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that is there, as micro-batches, into a table; batches are written once by their number."""
    spark = stream.sparkSession
    place = scratch(spark)
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{place}/out/batch=*")


def split_once(stream: DataFrame, routes: dict[str, Column]) -> dict[str, DataFrame]:
    """Everything that is there, each row into the table of every route whose condition it meets.

    A batch is read once and kept while it's written; batches that are tried again replace their own files.
    """
    spark, schema = stream.sparkSession, stream.schema
    place = scratch(spark)

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        for name, condition in routes.items():
            held.where(condition).write.mode("overwrite").parquet(f"{place}/{name}/batch={number}")
        held.unpersist()

    query = stream.writeStream.option("checkpointLocation", f"{place}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return {name: spark.read.schema(schema).parquet(f"{place}/{name}/batch=*") for name in routes}


LAPSED = "user_id long, lapsed_at long"


def lapsed_leases(events: DataFrame, lease_seconds: int = 60, delay: str = "0 seconds") -> DataFrame:
    """Leases that ran out without a result: (job, end in seconds), as soon as the watermark or a later event passes the end.

    A click or view takes the lease, any other event is the result that ends it.  Timers are in event time, so a replay
    gives the same rows; state of a job without a lease is dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else 0
        lapsed = []
        if state.hasTimedOut:
            lapsed, until = [until], 0
        else:
            rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
            for at, kind in zip(rows["at"].to_numpy().astype("datetime64[s]").astype("int64").tolist(), rows["event_type"], strict=True):
                if until and at > until:
                    lapsed.append(until)
                    until = 0
                until = at + lease_seconds if kind in ("click", "view") else 0
        if until:
            state.update((int(until),))
            state.setTimeoutTimestamp(max(until * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"user_id": [key[0]] * len(lapsed), "lapsed_at": lapsed}).astype("int64")

    rows = events.withWatermark("at", delay).select("user_id", "event_id", "at", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(step, LAPSED, "until long", "append", GroupStateTimeout.EventTimeTimeout)
