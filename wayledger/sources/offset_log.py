"""A stored log of rows with dense offsets by partition, and a streaming source that reads it.

A log is a folder: an append writes one run of Parquet files, by log partition and by segment (a
fixed number of offsets), and then publishes a manifest that names the live runs and where each
partition begins and ends. Readers see an append as a whole or not at all.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

from pyarrow import RecordBatch, dataset, fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .manifests import Manifests

PLACE = [StructField("log_partition", IntegerType()), StructField("log_offset", LongType())]
SEGMENT = 100_000


class OffsetLog:
    """The writer's side. One writer at a time: of two that append at once, one fails."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.manifests = spark, root.rstrip("/"), Manifests(spark, root)

    def newest(self) -> dict:
        versions = self.manifests.versions()
        return self.manifests.read(versions[-1]) if versions else {"version": 0, "starts": {}, "ends": {}, "runs": [], "schema": None, "segment": SEGMENT}

    def _publish(self, entry: dict) -> None:
        if not self.manifests.publish(entry | {"version": entry["version"] + 1}):
            raise RuntimeError(f"another writer changed {self.root} meanwhile")
        self.manifests.forget(2)

    def append(self, rows: DataFrame, partition: str, order: list[str], segment: int | None = None) -> None:
        """Add rows after those that are there: in each value of ``partition`` (an integer, null
        counts as 0) they get the next offsets in the order of ``order``.

        Rows are sorted over all tasks and written; their place in a file and the number of
        rows in the files before it make the offset, so that no partition has to fit in a task.
        The first append fixes the columns and the size of a segment. Names of columns that
        begin with ``log_`` are the log's own.
        """
        now, spark, name = self.newest(), self.spark, uuid.uuid4().hex
        rows = rows.withColumn("log_partition", F.coalesce(F.col(partition).cast("int"), F.lit(0)))
        staged = f"{self.root}/staged/{name}"
        rows.repartitionByRange("log_partition", *order).sortWithinPartitions("log_partition", *order).write.parquet(staged)
        placed = spark.read.schema(rows.schema).parquet(staged).select("*", F.col("_metadata.file_path").alias("log_file"), F.col("_metadata.row_index").alias("log_at"))
        # A file's name has the number of its task, and tasks have the sorted ranges in order.
        per = placed.groupBy("log_partition", "log_file").agg(F.min("log_at").alias("first"), F.count("*").alias("n")).withColumn("task", F.regexp_extract("log_file", r"part-(\d+)[^/]*$", 1).cast("int"))
        before = Window.partitionBy("log_partition").orderBy("task", "log_file").rowsBetween(Window.unboundedPreceding, -1)
        old = F.lit(0).cast("long") if not now["ends"] else F.coalesce(F.element_at(F.from_json(F.lit(json.dumps(now["ends"])), "map<string,bigint>"), F.col("log_partition").cast("string")), F.lit(0))
        base = per.withColumn("log_base", old + F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"))
        size = segment or SEGMENT if now["schema"] is None else now["segment"]
        done = placed.join(base.select("log_partition", "log_file", "log_base"), ["log_partition", "log_file"]).withColumn("log_offset", F.col("log_base") + F.col("log_at")).drop("log_file", "log_at", "log_base")
        done = done.withColumn("log_segment", F.floor(F.col("log_offset") / size)).withColumn("log_p", F.col("log_partition"))
        done.sortWithinPartitions("log_p", "log_segment").write.partitionBy("log_p", "log_segment").parquet(f"{self.root}/runs/log_run={name}")
        # One row a log partition.
        ends = {str(r["log_partition"]): r["n"] for r in per.groupBy("log_partition").agg(F.sum("n").alias("n")).collect()}
        after = now["ends"] | {p: now["ends"].get(p, 0) + n for p, n in ends.items()}
        run = {"name": name, "from": {p: now["ends"].get(p, 0) for p in ends}, "to": {p: after[p] for p in ends}}
        schema = StructType([f for f in rows.schema.fields if f.name != "log_partition"] + PLACE).json()
        self._publish(now | {"starts": {p: now["starts"].get(p, 0) for p in after}, "ends": after, "runs": now["runs"] + ([run] if ends else []), "schema": schema, "segment": size})
        self.manifests.delete(staged)

    def trim(self, starts: dict[int, int]) -> None:
        """Let partitions begin at later offsets; segments that lie before them are deleted."""
        now = self.newest()
        first = now["starts"] | {str(p): min(max(at, now["starts"][str(p)]), now["ends"][str(p)]) for p, at in starts.items()}
        kept = [r for r in now["runs"] if any(end > first[p] for p, end in r["to"].items())]
        self._publish(now | {"starts": first, "runs": kept})
        for run in now["runs"]:
            if run not in kept:
                self.manifests.delete(f"{self.root}/runs/log_run={run['name']}")
                continue
            for p in run["to"]:
                for s in range(run["from"][p] // now["segment"], min(first[p], run["to"][p]) // now["segment"]):
                    self.manifests.delete(f"{self.root}/runs/log_run={run['name']}/log_p={p}/log_segment={s}")

    def read(self) -> DataFrame:
        """The whole log as a table."""
        now = self.newest()
        if now["schema"] is None:
            raise ValueError(f"nothing was appended to {self.root} yet")
        schema = StructType.fromJson(json.loads(now["schema"]))
        paths = [f"{self.root}/runs/log_run={r['name']}" for r in now["runs"]]
        starts = self.bounds().select(F.col("partition").alias("log_partition"), "start")
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/runs").parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.join(F.broadcast(starts), "log_partition").where("log_offset >= start").select(schema.names)

    def bounds(self) -> DataFrame:
        """(partition, start, end): one row a partition; ``end`` is the offset to come next."""
        now = self.newest()
        return self.spark.createDataFrame([(int(p), now["starts"][p], end) for p, end in now["ends"].items()], "partition int, start long, end long")


class OffsetLogSource(DataSource):
    """Format ``offset_log``, for streams. Options:

    * ``path`` of the log;
    * ``startingOffsets``: ``earliest`` (the default), ``latest``, or JSON of offsets by partition;
      a partition that comes later starts at its beginning;
    * ``maxOffsetsPerPartition``: what a trigger takes of each partition at most. Such a bound
      needs ``positionLocation``, a folder of the query's own beside its checkpoint, as Spark
      doesn't tell this kind of source where a restarted query stands;
    * ``failOnDataLoss`` (the default is true): offsets that were trimmed before they were read
      are an error, or are passed over.

    A task reads a part of one segment, in batches. Rows carry ``log_partition`` and
    ``log_offset``. The log has to have had its first append.
    """

    @classmethod
    def name(cls) -> str:
        return "offset_log"

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(_manifest(self.options["path"])["schema"]))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(dict(self.options), schema)


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        o = {k.lower(): v for k, v in options.items()}
        self.path, self.columns = o["path"].rstrip("/"), schema.names
        self.starting, self.strict = o.get("startingoffsets", "earliest"), o.get("failondataloss", "true").lower() != "false"
        self.most, self.position = int(o.get("maxoffsetsperpartition", 0)), o.get("positionlocation")
        if self.most and not self.position:
            raise ValueError("maxOffsetsPerPartition needs positionLocation")
        self.at: dict[str, int] | None = None
        self.first: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        if self.first is None:
            now = _manifest(self.path)
            named = {"earliest": now["starts"], "latest": now["ends"]}
            self.first = now["starts"] | (named[self.starting] if self.starting in named else {str(p): int(x) for p, x in json.loads(self.starting).items()})
        return self.first

    def latestOffset(self) -> dict:
        now = _manifest(self.path)
        if self.at is None:
            self.at = (_recorded(self.position) if self.position else None) or self.initialOffset()
        at = {p: max(self.at.get(p, 0), now["starts"][p]) if not self.strict else self.at.get(p, now["starts"][p]) for p in now["ends"]}
        self.at = self.at | {p: max(at[p], min(end, at[p] + self.most) if self.most else end) for p, end in now["ends"].items()}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        now, out = _manifest(self.path), []
        for p, upto in end.items():
            lo = start.get(p, now["starts"].get(p, 0))
            if upto < lo:
                raise ValueError(f"partition {p}: {upto} lies before {lo}; does positionLocation belong to this checkpoint?")
            if lo < min(upto, now["starts"].get(p, 0)) and self.strict:
                raise ValueError(f"partition {p}: offsets {lo} to {min(upto, now['starts'][p])} are gone")
            lo, size = max(lo, now["starts"].get(p, 0)), now["segment"]
            for run in now["runs"]:
                a, b = max(lo, run["from"].get(p, 0)), min(upto, run["to"].get(p, 0))
                for s in range(a // size, (b - 1) // size + 1) if a < b else ():
                    out.append(InputPartition((f"{self.path}/runs/log_run={run['name']}/log_p={p}/log_segment={s}", max(a, s * size), min(b, (s + 1) * size))))
        # Spark has logged this batch: a query that restarts stands here, or plans this batch again.
        self.at = dict(end)
        if self.position:
            _record(self.position, self.at)
        return out

    def read(self, partition: InputPartition) -> Iterator[RecordBatch]:
        path, lo, hi = partition.value
        files, at = fs.FileSystem.from_uri(path)
        try:
            rows = dataset.dataset(at, filesystem=files, format="parquet")
            place = dataset.field("log_offset")
            yield from rows.to_batches(columns=self.columns, filter=(place >= lo) & (place < hi), batch_size=10_000, batch_readahead=1, fragment_readahead=1, use_threads=False)
        except FileNotFoundError:
            if self.strict:
                raise

    def commit(self, end: dict) -> None:
        pass


def _newest(folder: str) -> bytes | None:
    """The file with the greatest number for a name in a folder, if there is one."""
    files, at = fs.FileSystem.from_uri(folder)
    for _ in range(5):  # it may be deleted once there is a newer one
        names = [f for f in files.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.base_name.isdigit()]
        if not names:
            return None
        try:
            with files.open_input_stream(max(names, key=lambda f: f.base_name).path) as stream:
                return stream.read()
        except FileNotFoundError:
            continue
    raise RuntimeError(f"{folder} changes too fast to be read")


def _manifest(path: str) -> dict:
    found = _newest(f"{path.rstrip('/')}/manifests")
    if found is None:
        raise ValueError(f"nothing was appended to {path} yet")
    return json.loads(found)


def _recorded(folder: str) -> dict | None:
    found = _newest(folder)
    return None if found is None else json.loads(found)


def _record(folder: str, offsets: dict) -> None:
    """Put ``offsets`` into a file of its own, written aside and renamed, and keep one before."""
    files, at = fs.FileSystem.from_uri(folder)
    files.create_dir(at, recursive=True)
    draft = f"{at}/draft-{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as stream:
        stream.write(json.dumps(offsets).encode())
    files.move(draft, f"{at}/{time.time_ns():020d}")
    for old in sorted(f.path for f in files.get_file_info(fs.FileSelector(at)) if f.base_name.isdigit())[:-2]:
        files.delete_file(old)


def open_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The log at ``path`` as a stream."""
    spark.dataSource.register(OffsetLogSource)
    return spark.readStream.format("offset_log").options(path=path, **options).load()
