import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from wayledger.functions import exprs as X
from wayledger.operators import expenses as E
from wayledger.operators import telemetry as T
from wayledger.plans import oracles, queries
from wayledger.streaming import jobs
from wayledger.streaming.upserts import UpsertStore

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1, 8)


def event(n, minute, *, kind="ping", status="on_trip", fare=0.0, lat=12.98, lon=77.6, vehicle="V001", key=None, speed=10.0):
    return (key or f"e{n}", kind, None, "D001", vehicle, lat, lon, speed, status, fare, "t", 1, T0 + dt.timedelta(minutes=minute), "{}", n, T0 + dt.timedelta(minutes=minute))


SCHEMA = "event_id string, event_type string, trip_id string, driver_id string, vehicle_id string, lat double, lon double, speed double, status string, fare double, timestamp string, schema_version int, event_time timestamp_ntz, raw_value string, kafka_offset long, arrival_time timestamp_ntz"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def day(spark, rows):
    return {r["vehicle_id"]: r for r in T.vehicle_day(frame(spark, rows)).collect()}


def test_duplicate_hours_apart_counts_once(spark):
    got = day(spark, [event(1, 0, kind="trip_end", fare=200.0, key="a"), event(2, 360, kind="trip_end", fare=200.0, key="a")])
    assert (got["V001"]["trips"], got["V001"]["revenue"]) == (1, 200.0)


def test_invalid_rows_and_fares_of_pings_are_left_out(spark):
    got = day(spark, [event(1, 0, kind="trip_end", fare=100.0), event(2, 1, lat=18.0, kind="trip_end", fare=9.0), event(3, 2, speed=-10.0), event(4, 3, fare=50.0)])
    assert (got["V001"]["trips"], got["V001"]["revenue"]) == (1, 100.0)


def test_durations_drop_long_gaps(spark):
    got = day(spark, [event(1, 0), event(2, 10), event(3, 20, status="idle"), event(4, 30, status="idle"), event(5, 300)])
    assert (got["V001"]["on_trip_min"], got["V001"]["idle_min"], got["V001"]["online_min"]) == (20.0, 10.0, 30.0)


def test_impossible_jump_is_not_distance(spark):
    got = day(spark, [event(1, 0), event(2, 2, lat=13.05), event(3, 4)])
    assert got["V001"]["gps_km"] < 5


def test_verdict_order(spark):
    rows = [event(1, 0), event(2, 0, status="x", speed=-1.0), event(3, 0, lat=99.0, fare=-1.0), event(4, 0, fare=-1.0), event(5, 0, kind="bogus", status="x")]
    got = {r["kafka_offset"]: r["reason"] for r in T.validated(frame(spark, rows)).collect()}
    assert got == {1: None, 2: "bad_status", 3: "coords_out_of_bounds", 4: "negative_fare", 5: "bad_event_type"}


def test_zone_corners(spark):
    df = spark.createDataFrame([(13.06, 77.52), (12.90, 77.68), (13.07, 77.6), (None, 77.6)], "lat double, lon double")
    assert [r[0] for r in df.select(X.zone_id(F.col("lat"), F.col("lon"))).collect()] == ["Z01", "Z16", None, None]


def test_idle_alert_opens_at_45(spark):
    rows = [event(1, 0, status="idle"), event(2, 45, status="idle"), event(3, 0, status="idle", vehicle="V002"), event(4, 44, status="idle", vehicle="V002")]
    got = {r["vehicle_id"]: r["alert"] for r in T.idle_islands(T.clean(frame(spark, rows))).collect()}
    assert got == {"V001": True, "V002": False}


@pytest.mark.parametrize(("nets", "expect"), [([500, 300, 100], True), ([-50, 200, -30], True), ([100, -20, 300], False), ([5, 5, 5], False), ([5, 3], False)])
def test_trend(spark, nets, expect):
    df = spark.createDataFrame([("V001", f"2024-01-0{i + 1}", float(n)) for i, n in enumerate(nets)], "vehicle_id string, sim_date string, net_profit double")
    assert E.with_trend(df).orderBy(F.desc("sim_date")).first()["becoming_unprofitable"] is expect


def test_upsert_replay_keeps_one_row(spark, tmp_path):
    store = UpsertStore(spark, f"file://{tmp_path}/t", ["vehicle_id"], "vehicle_id string, x int")
    df = spark.createDataFrame([("V001", 1)], "vehicle_id string, x int")
    store.write(df, 0), store.write(df, 0), store.write(spark.createDataFrame([("V001", 2)], "vehicle_id string, x int"), 1)
    assert [r["x"] for r in store.read().collect()] == [2]


def test_replace_with_no_rows_empties_the_date(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "sim_date string, x int")
    jobs.replace_dates(df, root, ["2024-01-01", "2024-01-02"])
    jobs.replace_dates(df.where("x > 5"), root, ["2024-01-01"])
    assert [r["x"] for r in spark.read.parquet(root).collect()] == [2]


def test_stream_dedup_equals_batch(spark):
    f = queries.Fleet(spark, SF)
    batch = {r["event_id"] for r in T.clean(f.raw).select("event_id").collect()}
    assert {r["event_id"] for r in jobs.run_dedup(f.wire).select("event_id").collect()} == batch


@pytest.mark.parametrize("name", ["vehicle_day", "zone_hourly", "idle_islands", "expense_gate", "batch_vehicle_daily"])
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(oracles.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda data: sorted(repr(tuple(r)) for r in data)
    assert rows(tuple(r) for r in got.select(*cols).collect()) == rows(want.select(", ".join(cols)).fetchall())
