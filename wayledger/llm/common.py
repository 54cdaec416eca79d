"""Shared plumbing of the training-data operators: scratch tables, splits, sized joins."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table, as it is held in memory, up to which it may go to every task as a side of a
#: join: rows times ROW bytes. A row of three numbers takes about 90 there.
BROADCAST_BYTES, ROW = 64 << 20, 90
#: Makes Spark delete the shuffle files of a finished write at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of an Arrow batch. Texts are long: the default of 10,000 rows makes batches of tens of MB.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Rows that are decoded from a Parquet file at a time.
READ = "spark.sql.parquet.columnarReaderBatchSize"
#: Writing rows of some MB: row groups are cut by size from the first row on.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4", "parquet.block.size": str(16 << 20)}


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder that driver and executors share.

    The folder is ``spark.checkpoint.dir``. Only a local session without that
    setting (tests) falls back to a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str, **options: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str, large_rows: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage so
    that a lost executor costs a re-read, not a recomputation."""
    return _written(df, scratch(df.sparkSession, label), **(LARGE_ROWS if large_rows else {}))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whichever kind it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """The tables an operator works with, deleted as soon as nothing reads them any more.

    Used as a context: ``stored`` writes a table, ``drop`` deletes tables whose readers have
    finished, ``result`` writes the table that the operator returns, which is the only one
    that is left at the end.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []
        small_batches(spark)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[df for df, _ in self.tables])

    def path(self, label: str) -> str:
        """A folder of its own for files that are no table; it goes with the rest."""
        path = scratch(self.spark, label)
        self.tables.append((None, path))
        return path

    def stored(self, df: DataFrame, label: str, large_rows: bool = False) -> DataFrame:
        path = scratch(self.spark, label)
        out = _written(df, path, **(LARGE_ROWS if large_rows else {}))
        self.tables.append((out, path))
        return out

    def drop(self, *old: DataFrame | None) -> None:
        for df, path in [t for t in self.tables if any(t[0] is o for o in old)]:
            remove(self.spark, path)
            self.tables = [t for t in self.tables if t[1] != path]

    def result(self, df: DataFrame, label: str) -> DataFrame:
        return stored(df, label)


def sized(ids: DataFrame, most: int = BROADCAST_BYTES, row: int = ROW) -> DataFrame:
    """``ids`` (a stored table of narrow rows) with a broadcast hint if it takes at most ``most``
    bytes, its rows (of ``row`` bytes) counted first. A larger one is left to a shuffled join."""
    return F.broadcast(ids) if ids.count() * row <= most else ids


def small_batches(spark: SparkSession) -> None:
    """At most ROWS rows of texts travel between Spark and Python at a time from now on in this
    session; a batch is held several times over on both sides."""
    if int(spark.conf.get(BATCH, "10000")) > ROWS:
        spark.conf.set(BATCH, str(ROWS))


@contextmanager
def single_rows(spark: SparkSession):
    """Rows of an index are read from files and travel to Python one at a time: each is some MB."""
    held = {BATCH: spark.conf.get(BATCH, "10000"), READ: spark.conf.get(READ, "4096")}
    for name in held:
        spark.conf.set(name, "1")
    try:
        yield
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)


def crc_mod(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; the split rule of the learners."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
