"""The vehicle fold on typed state with timers, started from the batch layer and read as a table.

The rules are those of ``jobs.fold_vehicle``; here the state is a named value with a schema,
a timer declares a vehicle offline, and a new query can begin with the states that the batch
layer has, instead of with none. The state store must be RocksDB's (``typed_state``).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import spells as K
from ..operators import telemetry as T
from ..params import DEFAULT, Params
from . import jobs
from .upserts import UpsertStore

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NAME = "vehicle"
TIMES = ("seen", "idle_since", "opened_at")
#: The state as it is stored: times in microseconds, which a null can stand for.
STORED = ", ".join(f"{c} long" if c in TIMES else f"{c} {dict(x.split(' ') for x in jobs.STATE.split(', '))[c]}" for c in jobs.FIELDS)
#: States to begin with: the vehicle, and the fields of the state.
INITIAL = f"vehicle_id string, {jobs.STATE}"


def _micros(t: pd.Timestamp | None) -> int | None:
    return None if t is None or pd.isna(t) else pd.Timestamp(t).value // 1000


def _time(us: int | None) -> pd.Timestamp | None:
    return None if us is None or pd.isna(us) else pd.Timestamp(datetime.fromtimestamp(int(us) // 10**6, timezone.utc).replace(tzinfo=None)) + pd.Timedelta(microseconds=int(us) % 10**6)


class Held:
    """A vehicle's value and its one timer, as ``jobs.fold_vehicle`` wants them."""

    def __init__(self, handle: StatefulProcessorHandle, value, watermark: int, expired: bool = False):
        self.handle, self.value, self.watermark, self.hasTimedOut = handle, value, watermark, expired

    @property
    def exists(self) -> bool:
        return self.value.exists()

    @property
    def get(self) -> tuple:
        return tuple(_time(x) if c in TIMES else x for c, x in zip(jobs.FIELDS, self.value.get(), strict=True))

    def update(self, new: tuple) -> None:
        self.value.update(tuple(_micros(x) if c in TIMES else x for c, x in zip(jobs.FIELDS, new, strict=True)))

    def remove(self) -> None:
        self.value.clear()

    def getCurrentWatermarkMs(self) -> int:
        return self.watermark

    def setTimeoutTimestamp(self, ms: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)


class VehicleProcessor(StatefulProcessor):
    def __init__(self, p: Params = DEFAULT):
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState(NAME, STORED)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from jobs.fold_vehicle(key, rows, Held(self.handle, self.value, timerValues.getCurrentWatermarkInMs()), self.p)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.value.exists():
            yield from jobs.fold_vehicle(key, iter(()), Held(self.handle, self.value, timerValues.getCurrentWatermarkInMs(), True), self.p)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        held = Held(self.handle, self.value, timerValues.getCurrentWatermarkInMs())
        held.update(tuple(None if pd.isna(row[c]) else row[c] for c in jobs.FIELDS))
        quiet = int((pd.Timestamp(row["seen"]) + pd.Timedelta(minutes=self.p.offline_min)).timestamp() * 1000)
        held.setTimeoutTimestamp(max(quiet, held.watermark + 1))

    def close(self) -> None:
        pass


@contextmanager
def typed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start in here keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def batch_states(events: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The state of each vehicle after the clean events of the batch layer, as a stream would have
    it: nothing of one that has been silent for so long that the stream would have dropped it."""
    open_ = T.idle_islands(events, p, silence_minutes=p.offline_min).where("status = 'open'").select("vehicle_id", "idle_since", "opened_at")
    now = events.agg(F.max("event_time").alias("now"))
    states = T.latest_state(events).withColumnRenamed("event_time", "seen").join(open_, "vehicle_id", "left").join(F.broadcast(now))
    gone = F.timestamp_add("MINUTE", F.lit(p.offline_min + p.watermark_min), F.col("seen")) <= F.col("now")
    kinds = dict(c.split(" ") for c in INITIAL.split(", "))
    return states.where(~gone).select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])


def vehicle_state(stream: DataFrame, initial: DataFrame | None = None, p: Params = DEFAULT) -> DataFrame:
    """Current state of each vehicle and every idle-alert transition, one row each; ``initial``
    holds the states to begin with (``INITIAL``), read in the query's first batch only."""
    start = None if initial is None else initial.groupBy("vehicle_id")
    return stream.groupBy("vehicle_id").transformWithStateInPandas(VehicleProcessor(p), jobs.STATE_OUT, "Update", "eventTime", start)


def state_table(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """The states that a query's checkpoint holds: the vehicle, and its fields with times again."""
    rows = spark.read.format("statestore").option("stateVarName", NAME).option("operatorId", operator).load(checkpoint)
    time = lambda c: F.timestamp_micros(F.col(f"value.{c}")).cast("timestamp_ntz").alias(c)
    return rows.select("key.vehicle_id", *[time(c) if c in TIMES else F.col(f"value.{c}").alias(c) for c in jobs.FIELDS])


def run(wire: DataFrame, initial: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(newest state of each vehicle that had events, its alerts, the state table) after a stream."""
    spark, root = wire.sparkSession, jobs.folder(wire.sparkSession)
    rows = vehicle_state(jobs.prepared(jobs._source(wire, root)), initial)
    with typed_state(spark):
        rows.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(jobs.state_sink(spark, root)).start().awaitTermination()
    stores: tuple[UpsertStore, UpsertStore] = jobs.state_stores(spark, root)
    return stores[0].read(), stores[1].read(), state_table(spark, f"{root}/checkpoint")
