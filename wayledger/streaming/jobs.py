"""Structured Streaming jobs: dedup, windows, per-vehicle state, upserts and replacement."""

from __future__ import annotations

import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import exprs as X
from ..operators import telemetry as T
from ..params import DEFAULT, Params
from .upserts import UpsertStore

FIELDS = ["driver_id", "status", "zone_id", "lat", "lon", "speed", "trip_id", "seen", "idle_since", "opened_at"]
STATE = "driver_id string, status string, zone_id string, lat double, lon double, speed double, trip_id string, seen timestamp, idle_since timestamp, opened_at timestamp"
STATE_OUT = "vehicle_id string, driver_id string, status string, zone_id string, lat double, lon double, speed double, trip_id string, event_time timestamp, idle_since timestamp, opened_at timestamp, closed_at timestamp, idle_min double, change string"


def prepared(wire: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Source rows parsed and judged: the valid events with watermark, deduplicated on the id
    within it, with their zone."""
    e = T.valid(T.archived(wire), p).withColumn("event_time", F.col("event_time").cast("timestamp"))
    e = e.withWatermark("event_time", f"{p.watermark_min} minutes").dropDuplicatesWithinWatermark(["event_id"])
    return e.withColumn("zone_id", X.zone_id(F.col("lat"), F.col("lon"), p))


def fold_vehicle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, p: Params = DEFAULT) -> Iterator[pd.DataFrame]:
    """One vehicle's new events folded into its state: a row for every alert that opens or
    closes, and one (change "none") of the state that is left.

    Events are taken in time order, one older than the state is ignored. The idle clock starts
    when the vehicle turns idle. The alert opens at the event that completes ``idle_alert_min``
    and closes at the first event that isn't idle, with the minutes until then. A vehicle that
    has timed out is offline; its alert closes at its last event and its state is dropped.
    """
    held = dict(zip(FIELDS, state.get if state.exists else [None, "offline", *[None] * 8], strict=True))
    held |= {k: None for k, v in held.items() if pd.isna(v)}
    rows: list[tuple] = []

    def emit(change: str, until: pd.Timestamp, closed_at: pd.Timestamp | None = None) -> None:
        minutes = (until - held["idle_since"]).total_seconds() / 60 if held["idle_since"] is not None else 0.0
        rows.append((key[0], *held.values(), closed_at, round(minutes, 2), change))

    def out() -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in STATE_OUT.split(", ")])

    if state.hasTimedOut:
        if held["opened_at"] is not None:
            emit("closed", held["seen"], held["seen"])
        held |= {"status": "offline", "speed": 0.0, "trip_id": None, "idle_since": None, "opened_at": None}
        emit("none", held["seen"])
        state.remove()
        yield out()
        return
    new = pd.concat(list(frames)).sort_values(["event_time", "event_id"], kind="stable")
    # Plain numbers in the loop: an event is looked at as a whole only where a row is given out.
    at, idle = new["event_time"].to_numpy("datetime64[ns]").astype("int64").tolist(), (new["status"] == "idle").tolist()
    first = 0 if held["seen"] is None else bisect_left(at, pd.Timestamp(held["seen"]).value)
    since = None if held["idle_since"] is None else pd.Timestamp(held["idle_since"]).value
    was_idle, is_open, least = held["status"] == "idle", held["opened_at"] is not None, p.idle_alert_min * 60_000_000_000

    def take(i: int) -> None:
        if i >= first:
            e = next(new.iloc[i : i + 1].itertuples(index=False))
            begun = None if since is None else pd.Timestamp(since)
            held.update(driver_id=e.driver_id, status=e.status, zone_id=e.zone_id, lat=float(e.lat), lon=float(e.lon), speed=float(e.speed), trip_id=e.trip_id, seen=e.event_time, idle_since=begun)

    for i in range(first, len(at)):
        if not idle[i]:
            if is_open:
                take(i - 1)
                emit("closed", pd.Timestamp(at[i]), pd.Timestamp(at[i]))
                held["opened_at"], is_open = None, False
            since, was_idle = None, False
            continue
        if not was_idle or since is None:
            since = at[i]
        was_idle = True
        if not is_open and at[i] - since >= least:
            is_open = True
            take(i)
            held["opened_at"] = pd.Timestamp(at[i])
            emit("opened", held["opened_at"])
    take(len(at) - 1)
    if held["seen"] is None:
        return
    emit("none", held["seen"])
    state.update(tuple(held.values()))
    # The timeout is set beyond the watermark, as an earlier one is an error.
    quiet = int((held["seen"] + pd.Timedelta(minutes=p.offline_min)).timestamp() * 1000)
    state.setTimeoutTimestamp(max(quiet, state.getCurrentWatermarkMs() + 1))
    yield out()


def vehicle_state(stream: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Current state of each vehicle and every idle-alert transition, one row each."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return fold_vehicle(key, frames, state, p)

    return stream.groupBy("vehicle_id").applyInPandasWithState(fold, STATE_OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def alerts(transitions: DataFrame) -> DataFrame:
    """Alert rows by (vehicle_id, opened_at): open, or closed once a closing came."""
    best = F.max_by(F.struct("closed_at", "zone_id", "idle_min", F.when(F.col("change") == "closed", "closed").otherwise("open").alias("status")), F.col("change") == "closed")
    return transitions.where("change != 'none'").groupBy("vehicle_id", "opened_at").agg(best.alias("a")).select("vehicle_id", "opened_at", "a.*")


def append(root: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink of rows without key: a batch owns one partition, so a replay rewrites itself."""

    def write(df: DataFrame, batch: int) -> None:
        own(df, root, batch)

    return write


def replace_dates(df: DataFrame, root: str, dates: list[str]) -> None:
    """Replace whole dates of a partitioned table; a date without rows ends up empty."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    new = df.where(F.col("sim_date").isin(dates)).persist()
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sim_date").parquet(root)
    filled = {r["sim_date"] for r in new.select("sim_date").distinct().collect()}
    new.unpersist()
    for d in dates:
        if d not in filled:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/sim_date={d}"), True)


def quarantine(issues: DataFrame, root: str) -> None:
    """Append the quarantined lines of a run; a run that is repeated replaces its own."""
    issues.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sim_date", "run_id").parquet(root)


def folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def in_order(spark: SparkSession, root: str) -> None:
    """Give the files of a folder times in the order of their names: a file source delivers by
    time, and the tasks that wrote them end in any order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((f.getPath().getName(), f.getModificationTime(), f.getPath()) for f in files.listStatus(path))
    start = max((t for _, t, _ in found), default=0) - 1000 * len(found)
    for i, (_, _, file) in enumerate(found):
        files.setTimes(file, start + 1000 * i, -1)


#: Rows of a file that is delivered, and of all files that a trigger takes, at most.
FILE_ROWS, TRIGGER_ROWS = 50_000, 2_000_000


def deliver(wire: DataFrame, root: str, by: str, triggers: int = 4) -> int:
    """Write ``wire`` below ``root`` as files that a stream reads in the order of a time; how many
    of them a trigger is to take. Neither a file nor a trigger grows with the input: there are
    more files to a trigger, then more triggers."""
    rows = wire.count()
    triggers = max(triggers, -(-rows // TRIGGER_ROWS))
    files = max(1, -(-rows // (triggers * FILE_ROWS)))
    wire.repartitionByRange(triggers * files, by).write.parquet(f"{root}/in")
    in_order(wire.sparkSession, f"{root}/in")
    return files


def _source(wire: DataFrame, root: str) -> DataFrame:
    """``wire`` as a stream of files in event-time order."""
    files = deliver(wire, root, "sent_at")
    return wire.sparkSession.readStream.schema(wire.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")


def archive_sink(wire: DataFrame, root: str):
    """Start-ready writer of the archive: parsed rows appended by event date."""
    return T.archived(wire).writeStream.format("parquet").partitionBy("sim_date").outputMode("append").option("path", f"{root}/archive").option("checkpointLocation", f"{root}/archive-checkpoint")


def dlq_sink(wire: DataFrame, root: str, p: Params = DEFAULT):
    """Start-ready writer of rejected events as key and JSON value."""
    rows = T.dlq_payload(T.archived(wire), F.current_timestamp(), p).select("key", "value")
    return rows.writeStream.format("json").outputMode("append").option("path", f"{root}/dlq").option("checkpointLocation", f"{root}/dlq-checkpoint")


def intake(root: str, p: Params = DEFAULT) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink of archived rows, parsed once for three tables: the archive by event
    date, the rejected events and their numbers by reason.

    In each of them a batch owns its partitions, so a batch that is repeated, wholly or after
    some of the three were written, leaves no double rows.
    """

    def write(df: DataFrame, batch: int) -> None:
        judged = T.validated(df, p).persist()
        bad = judged.where("reason IS NOT NULL")
        own(judged.drop("reason"), f"{root}/archive", batch, "sim_date")
        own(T.dlq_payload(bad.drop("reason"), F.current_timestamp(), p).select("key", "value"), f"{root}/dlq", batch)
        own(bad.groupBy("reason").agg(F.count("*").alias("rows")), f"{root}/dlq_reasons", batch)
        judged.unpersist()

    return write


def own(df: DataFrame, root: str, batch: int, *by: str) -> None:
    """Write a batch's rows to partitions that are the batch's own."""
    df.withColumn("batch_id", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch_id").parquet(root)


def ddl(df: DataFrame) -> str:
    """The schema of a table or stream as text."""
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


ALERTS_OUT = "vehicle_id string, opened_at timestamp, closed_at timestamp, zone_id string, idle_min double, status string"


def state_stores(spark: SparkSession, root: str) -> tuple[UpsertStore, UpsertStore]:
    """The newest state of each vehicle, and the alerts by vehicle and opening."""
    return UpsertStore(spark, f"{root}/out", ["vehicle_id"], STATE_OUT.removesuffix(", change string")), UpsertStore(spark, f"{root}/alerts", ["vehicle_id", "opened_at"], ALERTS_OUT)


def state_sink(spark: SparkSession, root: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink of the vehicle fold: states and alerts go to tables of their own."""
    states, shown = state_stores(spark, root)

    def write(df: DataFrame, batch: int) -> None:
        df.persist()
        states.write(df.where("change = 'none'").drop("change"), batch)
        shown.write(alerts(df), batch)
        df.unpersist()

    return write


def _run(stream: DataFrame, root: str, mode: str) -> DataFrame:
    spark, schema = stream.sparkSession, ddl(stream)
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(append(f"{root}/out")).start()
    query.awaitTermination()
    return spark.read.schema(f"{schema}, batch_id long").parquet(f"{root}/out")


def run_archive(wire: DataFrame) -> DataFrame:
    root = folder(wire.sparkSession)
    archive_sink(_source(wire, root), root).trigger(availableNow=True).start().awaitTermination()
    return wire.sparkSession.read.schema(T.archived(wire).schema).parquet(f"{root}/archive")


def run_dlq(wire: DataFrame) -> DataFrame:
    root = folder(wire.sparkSession)
    dlq_sink(_source(wire, root), root).trigger(availableNow=True).start().awaitTermination()
    return wire.sparkSession.read.schema("key string, value string").json(f"{root}/dlq")


def run_dedup(wire: DataFrame) -> DataFrame:
    root = folder(wire.sparkSession)
    return _run(prepared(_source(wire, root)).select("event_id", "event_time"), root, "append").drop("batch_id")


def _windowed(wire: DataFrame, make: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    root = folder(wire.sparkSession)
    stream = make(prepared(_source(wire, root)))
    store = UpsertStore(wire.sparkSession, f"{root}/out", keys, ddl(stream))
    stream.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(store.write).start().awaitTermination()
    return store.read()


def run_zone_hourly(wire: DataFrame) -> DataFrame:
    return _windowed(wire, T.zone_hourly, ["zone_id", "window_start"])


def run_vehicle_daily(wire: DataFrame) -> DataFrame:
    return _windowed(wire, T.vehicle_daily_running, ["vehicle_id", "sim_day"])


def run_vehicle_state(wire: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(newest state of each vehicle, its idle alerts) after the whole stream."""
    spark, root = wire.sparkSession, folder(wire.sparkSession)
    rows = vehicle_state(prepared(_source(wire, root)))
    rows.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(state_sink(spark, root)).start().awaitTermination()
    states, shown = state_stores(spark, root)
    return states.read(), shown.read()
