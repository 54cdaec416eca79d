"""Tables that lie by vehicle and date: partitioned by ``sim_date``, bucketed by ``vehicle_id``.

A bucket holds all rows of its vehicles, sorted by time, one file per date. Readers see that
distribution, so windows and aggregates by vehicle, or by vehicle and date, need no exchange,
and a day is read from its partition alone. The folder is self-contained: ``describe`` makes a
table of it in any session, from the number of buckets that the file names end in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

KEY, DAY = "vehicle_id", "sim_date"


def default_buckets(spark: SparkSession) -> int:
    """As many buckets as a shuffle of this session has partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write(df: DataFrame, root: str, buckets: int, order: tuple[str, ...] = ("event_time", "event_id")) -> str:
    """Write ``df``, which must be distributed by ``vehicle_id`` in ``buckets`` partitions already
    (``repartition(buckets, "vehicle_id")``), so that a bucket of a date is one file. Returns the
    name of the table."""
    name = f"clustered_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, KEY).sortBy(KEY, *order).partitionBy(DAY).option("path", root).saveAsTable(name)
    return name


def describe(spark: SparkSession, root: str, schema: str, buckets: int, order: tuple[str, ...] = ("event_time", "event_id")) -> str:
    """Name a folder that ``write`` filled, in a session that doesn't know it."""
    name = f"clustered_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet PARTITIONED BY ({DAY}) CLUSTERED BY ({KEY}) SORTED BY ({', '.join((KEY, *order))}) INTO {buckets} BUCKETS LOCATION '{root}'")
    spark.sql(f"MSCK REPAIR TABLE {name}")
    return name
