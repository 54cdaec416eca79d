"""Start all streaming queries, and their progress as tables."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import health as H
from ..operators import telemetry as T
from ..params import DEFAULT, Params
from ..sources import offset_log
from ..sources.offset_log import OffsetLog
from . import jobs
from .upserts import UpsertStore

#: Options of the broker source, for the live jobs and for the archive.
BROKER = {"startingOffsets": "latest", "maxOffsetsPerTrigger": "20000", "failOnDataLoss": "false"}
BROKER_ARCHIVE = BROKER | {"startingOffsets": "earliest"}
PROGRESS = "query string, batch_id long, at string, input_rows long, input_rate double, processed_rate double, duration_ms long, newest_event string, late_rows long, offsets_behind double, end_offsets string"
LIFE = "query string, change string, at string"
KEYS = {"zone_hourly": ["zone_id", "window_start"], "vehicle_daily": ["vehicle_id", "sim_day"]}


def read_events(spark: SparkSession, source: str, options: dict[str, str], schema=None) -> DataFrame:
    """The telemetry stream with a text ``value``: ``source`` is a format, "kafka" or files.

    A broker's rows are bounded per trigger, start at the newest offset and outlive lost data
    unless ``options`` say otherwise; file sources take their own options.
    """
    if source == "kafka":
        options = BROKER | options
    reader = spark.readStream.format(source).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load()


def start_all(open_stream, root: str, p: Params = DEFAULT, trigger: dict | None = None) -> dict[str, StreamingQuery]:
    """Start every job on a stream of its own from ``open_stream(name)``, each with its checkpoint
    and output folder below ``root``: the intake, which reads and parses once for the archive,
    the rejected events and their numbers, and the live tables, whose states are their own."""
    when = trigger or {"processingTime": "5 seconds"}
    running: dict[str, StreamingQuery] = {}

    def start(name: str, mode: str, stream: DataFrame, sink: Callable[[DataFrame, int], None]) -> None:
        writer = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{root}/{name}/checkpoint")
        running[name] = writer.trigger(**when).foreachBatch(sink).start()

    start("intake", "append", T.archived(open_stream("intake")), jobs.intake(f"{root}/intake", p))
    hours, days = T.zone_hourly(jobs.prepared(open_stream("zone_hourly"), p)), T.vehicle_daily_running(jobs.prepared(open_stream("vehicle_daily"), p))
    for name, stream in (("zone_hourly", hours), ("vehicle_daily", days)):
        start(name, "update", stream, store(stream.sparkSession, root, name, jobs.ddl(stream)).write)
    start("dedup", "append", jobs.prepared(open_stream("dedup"), p).select("event_id", "event_time"), jobs.append(f"{root}/dedup/out"))
    states = jobs.vehicle_state(jobs.prepared(open_stream("vehicle_state"), p), p)
    start("vehicle_state", "update", states, jobs.state_sink(states.sparkSession, f"{root}/vehicle_state"))
    return running


def store(spark: SparkSession, root: str, name: str, schema: str) -> UpsertStore:
    """The table of one of the jobs that upsert."""
    return UpsertStore(spark, f"{root}/{name}/out", KEYS[name], schema)


class ProgressLog(StreamingQueryListener):
    """Keeps a row for every micro-batch of every query, and one for its start and its end;
    ``flush`` and ``flush_life`` append them to tables.

    Register it with ``spark.streams.addListener``. What hasn't been flushed is held in the
    driver: a few hundred bytes a batch.
    """

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.life: list[tuple] = []
        self.names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name or "unnamed"
        self.life.append((event.name or "unnamed", "started", event.timestamp))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        at = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
        self.life.append((self.names.pop(str(event.runId), "unnamed"), "ended", at))

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        dropped = sum(s.get("numRowsDroppedByWatermark", 0) for s in p["stateOperators"])
        behind = [_number((s.get("metrics") or {}).get("maxOffsetsBehindLatest", (s.get("metrics") or {}).get("offsetsBehindLatest"))) for s in p["sources"]]
        known = [x for x in behind if x is not None]
        self.rows.append((p.get("name") or "unnamed", p["batchId"], p["timestamp"], p["numInputRows"], _number(p.get("inputRowsPerSecond")), _number(p.get("processedRowsPerSecond")), p.get("durationMs", {}).get("triggerExecution"), (p.get("eventTime") or {}).get("max"), dropped, sum(known) if known else None, _offsets(p["sources"])))

    def flush(self, spark: SparkSession, root: str) -> DataFrame:
        """Append what came since the last flush; the whole table."""
        rows, self.rows = self.rows, []
        return _appended(spark, rows, PROGRESS, root)

    def flush_life(self, spark: SparkSession, root: str) -> DataFrame:
        """Append the starts and ends since the last time; the whole table."""
        life, self.life = self.life, []
        return _appended(spark, life, LIFE, root)


def _appended(spark: SparkSession, rows: list[tuple], schema: str, root: str) -> DataFrame:
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(root)
    return spark.read.schema(schema).parquet(root)


def _offsets(sources: list[dict]) -> str | None:
    """Where a batch ended, as JSON of offsets by partition, if its one source has such."""
    ends = sources[0].get("endOffset") if len(sources) == 1 else None
    return json.dumps(ends) if isinstance(ends, dict) and all(isinstance(x, int) for x in ends.values()) else None


def _number(x) -> float | None:
    return None if x is None or float(x) != float(x) else float(x)


def late_rows(progress: DataFrame) -> DataFrame:
    """Rows that the watermark dropped, and all rows read, by query."""
    return progress.groupBy("query").agg(F.sum("late_rows").alias("late_rows"), F.sum("input_rows").alias("input_rows"))


def freshness(progress: DataFrame) -> DataFrame:
    """When each query last made progress, its newest event, and how far it is behind."""
    at = F.expr("try_to_timestamp(at)").cast("timestamp_ntz")
    return progress.withColumn("at", at).groupBy("query").agg(F.max("at").alias("last_at"), F.max(F.expr("try_to_timestamp(newest_event)").cast("timestamp_ntz")).alias("newest_event"), F.max_by("offsets_behind", "at").alias("offsets_behind"))


def behind(progress: DataFrame, log: OffsetLog) -> DataFrame:
    """(query, batch_id, partition, reached, behind) of every batch that read from ``log``: the
    offset that comes next in each partition, and the rows that the log has beyond it now."""
    now = log.newest()
    ends = F.from_json(F.lit(json.dumps(now["ends"])), "map<string,bigint>")
    begin = F.from_json(F.lit(json.dumps(now["starts"])), "map<string,bigint>")
    b = progress.where("end_offsets IS NOT NULL").withColumn("at_end", F.from_json("end_offsets", "map<string,bigint>"))
    b = b.select("query", "batch_id", "input_rows", "at_end", F.explode(ends).alias("p", "end"))
    reached = F.coalesce(F.element_at("at_end", F.col("p")), F.element_at(begin, F.col("p")))
    return b.select("query", "batch_id", "input_rows", F.col("p").cast("int").alias("partition"), reached.alias("reached"), (F.col("end") - reached).alias("behind"))


def with_backlog(progress: DataFrame, log: OffsetLog) -> DataFrame:
    """Progress with ``offsets_behind`` over all partitions of ``log`` where its source has none."""
    per = behind(progress, log).groupBy("query", "batch_id").agg(F.sum("behind").cast("double").alias("behind"))
    return progress.join(per, ["query", "batch_id"], "left").withColumn("offsets_behind", F.coalesce("offsets_behind", "behind")).drop("behind")


def stalled(life: DataFrame, progress: DataFrame, now: DataFrame, silent_s: int = 120, grace_s: int = 120) -> DataFrame:
    """Queries that need a restart by their own starts, ends and batches; ``now`` is one row.
    Batches before a query's newest start don't count."""
    at = F.expr("try_to_timestamp(at)").cast("timestamp_ntz")
    e = life.withColumn("at", at)
    launched = e.groupBy("query").agg(F.max(F.when(F.col("change") == "started", F.col("at"))).alias("started_at"), (F.max_by("change", F.struct("at", F.col("change") == "ended")) == "started").alias("active"))
    since = progress.select("query", at.alias("at")).join(launched.select("query", "started_at"), "query").where("at >= started_at")
    return H.stalled(launched, since.select("query", "at"), now, silent_s, grace_s)


def logged(wire: DataFrame, root: str) -> OffsetLog:
    """``wire`` as a log below ``root``, by source partition in the order of arrival."""
    log = OffsetLog(wire.sparkSession, f"{root}/log")
    log.append(wire, "kafka_partition", ["arrival_time", "kafka_offset"])
    return log


def bounded(log: OffsetLog, root: str, most: int) -> DataFrame:
    """A stream of the log of which a trigger takes ``most`` offsets a partition, for the query
    that has its folders below ``root``."""
    return offset_log.open_stream(log.spark, log.root, maxOffsetsPerPartition=str(most), positionLocation=f"{root}/position")


def run_until_read(start: Callable[[], dict[str, StreamingQuery]], root: str, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Run queries until nothing is left to read, and end them; (progress, starts and ends)."""
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        running = start()
        for query in running.values():
            query.processAllAvailable()
        newest = {name: q.lastProgress["batchId"] for name, q in running.items() if q.lastProgress}
        for query in running.values():
            query.stop()
        for _ in range(100):  # the listener hears of a batch or an end a moment later
            ended = {name for name, change, _ in log.life if change == "ended"}
            if running.keys() <= ended and all(any(r[0] == name and r[1] >= batch for r in log.rows) for name, batch in newest.items()):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    return log.flush(spark, f"{root}/progress"), log.flush_life(spark, f"{root}/life")


def run_all(wire: DataFrame, triggers: int = 4) -> tuple[str, DataFrame, DataFrame]:
    """All jobs over ``wire``, delivered as it arrived in ``triggers`` parts (more of them where one
    would be beyond what a trigger may take), until nothing is left; (their folder, the progress
    of every batch, starts and ends)."""
    spark, root = wire.sparkSession, jobs.folder(wire.sparkSession)
    log = logged(wire, root)
    most = share_offsets(log, triggers)
    again = lambda name: bounded(log, f"{root}/{name}", most)
    progress, life = run_until_read(lambda: start_all(again, root, trigger={"processingTime": "0 seconds"}), root, spark)
    return root, with_backlog(progress, log), life


def outputs(spark: SparkSession, root: str) -> DataFrame:
    """(query, rows): what each query left, an updated row once."""
    key = lambda name: f"{KEYS[name][0]} string"
    live = {name: store(spark, root, name, key(name)).manifest()["runs"] for name in KEYS}
    tables = {
        "archive": spark.read.parquet(f"{root}/intake/archive"), "dlq": spark.read.parquet(f"{root}/intake/dlq"), "dlq_reasons": spark.read.parquet(f"{root}/intake/dlq_reasons").groupBy("reason").agg(F.sum("rows")),
        "dedup": spark.read.parquet(f"{root}/dedup/out"), "vehicle_state": jobs.state_stores(spark, f"{root}/vehicle_state")[0].read(),
    }
    for name, runs in live.items():
        paths = [f"{root}/{name}/out/runs/{r['name']}" for r in runs]
        tables[name] = spark.read.parquet(*paths).select(*KEYS[name]).distinct() if paths else spark.createDataFrame([], key(name))
    return reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("query"), F.count("*").alias("rows")) for name, df in tables.items()])


#: Triggers that a run over a whole log aims at, and offsets of a partition that one takes at most.
TRIGGERS, MOST = 16, 320_000


def share_offsets(log: OffsetLog, triggers: int) -> int:
    """What a trigger takes of each partition if ``triggers`` of them are to read the log: at most
    ``MOST``, as what the jobs hold in memory grows with a trigger."""
    return max(1, min(-(-max(log.newest()["ends"].values(), default=0) // triggers), MOST))


def trigger_offsets(log: OffsetLog, step: int) -> int:
    """What a trigger takes of each partition: whole steps, as many as make ``TRIGGERS`` triggers of
    the log, so that their number doesn't grow with it until a trigger is as large as it may be."""
    longest = max(log.newest()["ends"].values(), default=0)
    return step * max(1, min(-(-longest // (step * TRIGGERS)), MOST // step))


def run_bounded(wire: DataFrame, step: int, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, OffsetLog]:
    """``keep`` over a stream of ``wire``'s log in triggers of whole steps of ``step`` offsets a
    partition; (its rows, the progress of every batch, the log)."""
    spark, root = wire.sparkSession, jobs.folder(wire.sparkSession)
    log = logged(wire, root)
    stream = keep(bounded(log, root, trigger_offsets(log, step)))
    progress = _run_bounded(stream, root, jobs.append(f"{root}/out"))
    return spark.read.schema(f"{jobs.ddl(stream)}, batch_id long").parquet(f"{root}/out"), progress, log


def _run_bounded(stream: DataFrame, root: str, sink: Callable[[DataFrame, int], None]) -> DataFrame:
    start = lambda: {"bounded": stream.writeStream.queryName("bounded").option("checkpointLocation", f"{root}/checkpoint").foreachBatch(sink).start()}
    return run_until_read(start, root, stream.sparkSession)[0]


def run_source(wire: DataFrame, step: int) -> DataFrame:
    """Everything that the source delivers, parsed, with the broker's offsets."""
    return run_bounded(wire, step, lambda s: T.parse(s, "value").select("event_id", "vehicle_id", "status", "kafka_offset"))[0].drop("batch_id")


#: What a stepped stream has seen of each step and partition: the newest valid event, and the offset to come next.
STEPS = "batch long, partition int, top timestamp_ntz, reached long"
KEPT = "event_id string, kafka_offset long, log_partition int, log_offset long"


def not_late(root: str, step: int, p: Params = DEFAULT) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink of a log: the valid events that the watermark lets through, which moves
    after every ``step`` offsets of a partition, as in a stream with triggers of that size.

    A batch may hold many steps, whole ones. What it has seen of each is kept below ``root`` with
    its rows, and a row is held against the steps before its own, in this batch or earlier ones.
    """

    def write(df: DataFrame, batch: int) -> None:
        e = T.validated(T.archived(df), p).withColumn("batch", F.floor(F.col("log_offset") / step))
        e = e.select("event_id", "kafka_offset", "log_partition", "log_offset", "event_time", "reason", "batch").persist()
        ok = F.col("reason").isNull()
        seen = e.groupBy("batch", F.col("log_partition").alias("partition")).agg(F.max(F.when(ok, F.col("event_time"))).alias("top"), (F.max("log_offset") + 1).alias("reached"))
        jobs.own(seen, f"{root}/steps", batch)
        known = steps(df.sparkSession, root).where(F.col("batch_id") <= batch).groupBy("batch").agg(F.max("top").alias("top"))
        j = e.where(ok).join(F.broadcast(T.watermarks(known)), "batch", "left")
        in_time = F.col("event_time") > F.expr(f"timestampadd(MINUTE, -{p.watermark_min}, seen)")
        jobs.own(j.where(F.coalesce(in_time, F.lit(True))).select("event_id", "kafka_offset", "log_partition", "log_offset"), f"{root}/out", batch)
        e.unpersist()

    return write


def steps(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(f"{STEPS}, batch_id long").parquet(f"{root}/steps")


def run_stepped(wire: DataFrame, step: int) -> tuple[DataFrame, DataFrame, DataFrame, OffsetLog]:
    """The events of ``wire``'s log that a stream with a watermark lets through, in steps of
    ``step`` offsets a partition; (its rows, its steps, the progress of every batch, the log)."""
    spark, root = wire.sparkSession, jobs.folder(wire.sparkSession)
    log = logged(wire, root)
    progress = _run_bounded(bounded(log, root, trigger_offsets(log, step)), root, not_late(root, step))
    return spark.read.schema(f"{KEPT}, batch_id long").parquet(f"{root}/out"), steps(spark, root), progress, log


def steps_behind(seen: DataFrame, log: OffsetLog) -> DataFrame:
    """(batch_id, partition, reached, behind) after every step: the offset that comes next in each
    partition, and the rows that the log has beyond it now."""
    grid = seen.select("batch").distinct().join(F.broadcast(log.bounds()))
    so_far = F.max("reached").over(Window.partitionBy("partition").orderBy("batch"))
    at = grid.join(seen.select("batch", "partition", "reached"), ["batch", "partition"], "left").withColumn("reached", F.coalesce(so_far, "start"))
    return at.select(F.col("batch").alias("batch_id"), "partition", "reached", (F.col("end") - F.col("reached")).alias("behind"))
