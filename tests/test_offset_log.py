"""The stored log and its source: offsets, bounds, restarts, lost rows, late rows in triggers."""

import random

import pytest
from pyspark.sql import functions as F

from wayledger.operators import telemetry as T
from wayledger.sources.offset_log import OffsetLog, open_stream
from wayledger.streaming import jobs, monitor

SCHEMA = "p int, n long, text string"


def _rows(spark, lo, hi):
    """A third of the rows in partition 0; equal texts; one row without a partition."""
    return spark.createDataFrame([(None if n == 5 else (0 if n % 3 == 0 else n % 4), n, "x" * (n % 3)) for n in range(lo, hi)], SCHEMA)


def _log(spark, n=100, segment=10):
    log = OffsetLog(spark, jobs.folder(spark))
    log.append(_rows(spark, 0, n), "p", ["n"], segment)
    return log


def _drain(log, root, **options):
    query = open_stream(log.spark, log.root, **options).writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(jobs.append(f"{root}/out")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return log.spark.read.schema(f"{SCHEMA}, log_partition int, log_offset long, batch_id long").parquet(f"{root}/out")


def _places(df):
    return sorted((r["log_partition"], r["log_offset"], r["n"]) for r in df.collect())


def _expected(lo, hi, base=None):
    ends, out = dict(base or {}), []
    for n in range(lo, hi):
        p = 0 if n == 5 or n % 3 == 0 else n % 4
        out.append((p, ends.get(p, 0), n))
        ends[p] = ends.get(p, 0) + 1
    return sorted(out), ends


def test_offsets_are_dense_in_order_and_go_on(spark):
    log = _log(spark)
    first, ends = _expected(0, 100)
    assert _places(log.read()) == first
    log.append(_rows(spark, 100, 130), "p", ["n"])
    more, ends = _expected(100, 130, ends)
    assert _places(log.read()) == sorted(first + more)
    assert {r["partition"]: (r["start"], r["end"]) for r in log.bounds().collect()} == {p: (0, e) for p, e in ends.items()}
    log.append(_rows(spark, 0, 0), "p", ["n"])
    assert log.read().count() == 130


def test_bounded_triggers_and_restart(spark):
    log, root = _log(spark), jobs.folder(spark)
    options = {"maxOffsetsPerPartition": "8", "positionLocation": f"{root}/position"}
    got = _drain(log, root, **options)
    assert _places(got) == _expected(0, 100)[0]
    # Trigger i has the offsets from 8 i on, and no more.
    assert got.where(F.col("batch_id") != F.floor(F.col("log_offset") / 8)).isEmpty()
    before = got.agg(F.max("batch_id")).first()[0]
    log.append(_rows(spark, 100, 160), "p", ["n"])
    again = _drain(log, root, **options)
    assert _places(again) == _places(log.read())
    new = again.where(F.col("batch_id") > before)
    assert new.count() == 60 and new.groupBy("batch_id", "log_partition").count().agg(F.max("count")).first()[0] <= 8


def test_where_to_start(spark):
    log, root = _log(spark), jobs.folder(spark)
    ends = _expected(0, 100)[1]
    late = _drain(log, f"{root}/a", startingOffsets=f'{{"0": 30, "1": {ends[1] - 2}, "2": {ends[2]}, "3": {ends[3]}}}')
    assert late.where("log_partition = 0").agg(F.min("log_offset")).first()[0] == 30
    assert late.where("log_partition = 1").count() == 2 and late.where("log_partition > 1").isEmpty()
    query = open_stream(spark, log.root, startingOffsets="latest").writeStream.option("checkpointLocation", f"{root}/b/checkpoint").foreachBatch(jobs.append(f"{root}/b/out")).start()
    query.processAllAvailable()
    log.append(_rows(spark, 100, 110), "p", ["n"])
    query.processAllAvailable()
    query.stop()
    assert sorted(r["n"] for r in spark.read.parquet(f"{root}/b/out").collect()) == list(range(100, 110))
    with pytest.raises(Exception, match="positionLocation"):
        _drain(log, f"{root}/c", maxOffsetsPerPartition="5")


def test_trimmed_rows(spark):
    log, root = _log(spark), jobs.folder(spark)
    bound = {"maxOffsetsPerPartition": "10", "positionLocation": f"{root}/position"}
    _drain(log, root, **bound)
    log.append(_rows(spark, 100, 200), "p", ["n"])
    ends = {r["partition"]: r["end"] for r in log.bounds().collect()}
    log.trim({0: ends[0] - 5})
    assert log.read().where("log_partition = 0").count() == 5
    with pytest.raises(Exception, match="are gone"):
        _drain(log, root, **bound)
    over = _drain(log, f"{root}/new", failOnDataLoss="false")
    assert _places(over) == _places(log.read())


def test_late_rows_follow_the_triggers(spark):
    rng, most = random.Random(5), 7
    rows = []
    for p, n in ((0, 120), (1, 40), (2, 3)):
        for o in range(n):
            minute = None if rng.random() < 0.05 else o * (2 if p == 0 else 5) - (rng.randrange(60) if rng.random() < 0.2 else 0)
            rows.append((p, o, minute, rng.random() < 0.1))
    df = spark.createDataFrame(rows, "log_partition int, log_offset long, minute int, bad boolean")
    good = {"event_id": "cast(log_offset AS string)", "event_type": "'ping'", "trip_id": "cast(null AS string)", "driver_id": "'D'", "vehicle_id": "'V'", "lat": "13.0d", "lon": "77.6d", "speed": "cast(IF(bad, -1, 1) AS double)", "status": "'idle'", "fare": "0d", "raw_value": "'{}'"}
    df = df.withColumns({c: F.expr(x) for c, x in good.items()}).withColumn("event_time", F.expr("timestampadd(MINUTE, minute, timestamp_ntz'2024-01-01 06:00:00')"))
    df = df.withColumn("timestamp", F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'")).withColumn("schema_version", F.lit(1))
    ok = [(p, o, m) for p, o, m, bad in rows if m is not None and not bad]
    expected = []
    for p, o, m in ok:
        seen = [x for _, q, x in ok if q // most <= o // most - 2]
        if seen and m <= max(seen) - 10:
            expected.append((p, o))
    for block in (2, 4096):
        got = sorted((r["log_partition"], r["log_offset"]) for r in T.late_in_triggers(df, most, block=block).collect())
        assert got == sorted(expected) and expected
    assert T.late_in_triggers(df.where("false"), most).isEmpty()


def test_backlog_and_stalls(spark):
    log = _log(spark)
    ends = _expected(0, 100)[1]
    progress = spark.createDataFrame([("a", 0, "2024-01-01T00:00:10.000Z", 5, '{"0": 10}'), ("a", 1, "2024-01-01T00:05:00.000Z", 5, '{"0": 20, "1": 3}'), ("b", 0, "2024-01-01T00:00:20.000Z", 5, None)], "query string, batch_id long, at string, input_rows long, end_offsets string")
    got = {(r["query"], r["batch_id"], r["partition"]): r["behind"] for r in monitor.behind(progress, log).collect()}
    assert got == {("a", i, p): e - {0: {0: 10}, 1: {0: 20, 1: 3}}[i].get(p, 0) for i in (0, 1) for p, e in ends.items()}
    life = spark.createDataFrame([("a", "started", "2024-01-01T00:00:00.000Z"), ("b", "started", "2024-01-01T00:00:00.000Z"), ("c", "started", "2024-01-01T00:00:00.000Z"), ("d", "started", "2024-01-01T00:00:00.000Z"), ("d", "ended", "2024-01-01T00:01:00.000Z"), ("e", "started", "2024-01-01T00:04:00.000Z")], monitor.LIFE)
    report = lambda at: {r["query"]: r["reason"] for r in monitor.stalled(life, progress, spark.sql(f"SELECT timestamp_ntz'{at}' AS now")).collect()}
    assert report("2024-01-01 00:01:30") == {"d": "inactive"}
    assert report("2024-01-01 00:05:30") == {"b": "silent", "c": "no_progress", "d": "inactive"}
