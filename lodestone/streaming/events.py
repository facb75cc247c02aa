"""Structured Streaming over events: windows, change feeds, deduplication and alerts with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.sources.shared import new_folder

DEFAULT_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_files(spark: SparkSession, path: str, files_per_trigger: int = 1, schema: str = EVENTS) -> DataFrame:
    """New Parquet files of a folder, in order, a few for each trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, ts: str = "ts", width: str = "6 hours", slide: str | None = None, late: str = "1 hour", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and mean value of each key and window; events later than the watermark don't count."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w, *by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def session_counts(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour", by: str = "user_id") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def status_changes(chats: DataFrame, emit: Callable[[DataFrame, int], None], status: str = "status", checkpoint: str | None = None):  # noqa: ANN201
    """Start a change feed: after each trigger ``emit`` gets the new total of each status that changed."""
    counts = chats.groupBy(status).agg(F.count("*").alias("n"))
    writer = counts.writeStream.outputMode("update").foreachBatch(emit)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).trigger(availableNow=True).start()


def alerts(events: DataFrame, key: str = "user_id", value: str = "value", order: str = "ts", enter: float = 0.35, enter_n: int = 2, leave: float = 0.15, leave_n: int = 3) -> DataFrame:
    """(key, ts, active) whenever a key's alert goes on or off.

    It goes on after ``enter_n`` values in a row of at least ``enter`` and off
    after ``leave_n`` of at most ``leave``. A key's state is three numbers.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active, ups, downs = state.get if state.exists else (False, 0, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values(order)
        for at, x in zip(rows[order], rows[value], strict=True):
            ups = ups + 1 if not active and x >= enter else 0
            downs = downs + 1 if active and x <= leave else 0
            if ups >= enter_n or downs >= leave_n:
                active, ups, downs = not active, 0, 0
                out.append((k[0], at, active))
        state.update((active, ups, downs))
        yield pd.DataFrame(out, columns=[key, order, "active"])

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {order} timestamp, active boolean", "active boolean, ups int, downs int", "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything that is there now, as a table of files in the shared folder; complete results are those of the last trigger.

    Neither rows nor state pass through the driver's memory: each trigger writes
    its rows as files, checkpoints lie in the shared folder, and state is in
    RocksDB on the executors' disks.
    """
    spark = df.sparkSession
    path = new_folder(spark, "streams")
    triggers: list[int] = []

    def keep(rows: DataFrame, trigger: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/{trigger}")
        triggers.append(trigger)

    with rocks_state(spark):
        started = df.writeStream.foreachBatch(keep).queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    done = sorted(set(triggers))
    if not done:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(*(f"{path}/rows/{t}" for t in (done[-1:] if mode == "complete" else done)))


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start here keep their state in RocksDB, unless the session names another store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name, DEFAULT_STORE) != DEFAULT_STORE:
        yield
        return
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.unset(name)
