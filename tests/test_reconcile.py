"""Profit figures, drift, live counts, the expense gate and the tables that jobs write."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wayledger.functions import exprs as X
from wayledger.operators import expenses as E
from wayledger.operators import health as H
from wayledger.operators import serving as S
from wayledger.operators import telemetry as T
from wayledger.streaming import jobs

DAYS = "sim_date string, vehicle_id string, trips long, revenue double, gps_km double, online_min double, on_trip_min double, idle_min double, utilization double"
COSTS = "sim_date string, vehicle_id string, fuel_cost double, maintenance_cost double, distance_covered double, service_flag boolean"
D = "2024-01-01"


def reconciled(spark, days, costs):
    days = spark.createDataFrame([(D, v, 1, revenue, km, 0.0, 0.0, 0.0, 0.0) for v, revenue, km in days], DAYS)
    return {r["vehicle_id"]: r for r in E.reconciled(days, spark.createDataFrame([(D, *c) for c in costs], COSTS)).collect()}


def test_profit_arithmetic(spark):
    r = reconciled(spark, [("V001", 1000.0, 100.0)], [("V001", 300.0, 100.0, 100.0, False)])["V001"]
    assert (r["total_cost"], r["net_profit"], r["margin"], r["revenue_per_km"], r["cost_per_km"], r["mismatch_pct"]) == (400.0, 600.0, 0.6, 10.0, 4.0, 0.0)


def test_costs_are_per_gps_kilometre_and_rounded_to_four_places(spark):
    r = reconciled(spark, [("V001", 100.0, 30.0)], [("V001", 20.0, 10.0, 200.0, False)])["V001"]
    assert (r["revenue_per_km"], r["cost_per_km"], r["mismatch_pct"], r["distance_mismatch"]) == (3.3333, 1.0, 0.85, True)


def test_zero_revenue_and_zero_distance_stay_in(spark):
    r = reconciled(spark, [("V001", 0.0, 0.0)], [("V001", 50.0, 0.0, 0.0, True)])["V001"]
    assert (r["margin"], r["revenue_per_km"], r["cost_per_km"], r["mismatch_pct"]) == (0.0, 0.0, 0.0, 0.0)
    assert (r["unprofitable"], r["low_margin"], r["in_service"]) == (True, False, True)


def test_full_outer_join_keeps_both_one_sided_vehicles(spark):
    got = reconciled(spark, [("V001", 100.0, 10.0), ("V002", 50.0, 5.0)], [("V001", 10.0, 5.0, 10.0, False), ("V003", 20.0, 5.0, 80.0, False)])
    assert set(got) == {"V001", "V002", "V003"}
    assert (got["V002"]["missing_costs"], got["V002"]["missing_telemetry"], got["V002"]["total_cost"]) == (True, False, 0.0)
    # Billed without telemetry: all of the reported distance is missing.
    assert (got["V003"]["missing_telemetry"], got["V003"]["mismatch_pct"], got["V003"]["distance_mismatch"], got["V003"]["net_profit"]) == (True, 1.0, True, -25.0)


def test_reason_texts(spark):
    flags = dict.fromkeys(S.FLAGS, False) | {"unprofitable": True, "low_margin": True, "missing_telemetry": True}
    df = spark.range(1).select(F.lit(-12.5).alias("net_profit"), F.lit(0.051).alias("margin"), F.lit(0.2).alias("mismatch_pct"), *[F.lit(v).alias(k) for k, v in flags.items()])
    assert df.select(X.reasons()).first()[0] == ["net profit -12.50 CU is negative", "margin 5.1% is below the 10% threshold", "expense row present but no telemetry"]


def test_display_formats(spark):
    df = spark.createDataFrame([(1234567.891, 0.1234), (None, None)], "a double, b double")
    assert [tuple(r) for r in df.select(X.thousands(F.col("a")), X.percent(F.col("b"))).collect()] == [("1,234,567.89", "12.3%"), ("-", "-")]


def test_drift_keeps_its_sign_and_judges_the_kept_copy(spark):
    at = dt.datetime(2024, 1, 1, 8)
    rows = [("a", 1, D, "trip_end", 100.0, at), ("b", 2, D, "trip_end", 50.0, at)]
    events = spark.createDataFrame(rows, "event_id string, kafka_offset long, sim_date string, event_type string, fare double, event_time timestamp_ntz")
    late = spark.createDataFrame([("a", 99), ("b", 2)], "event_id string, kafka_offset long")
    r = S.drift(events, late).first()
    assert (r["speed_revenue"], r["batch_revenue"], r["drift_abs"], r["drift_ratio"]) == (100.0, 150.0, 50.0, 0.333333)
    rule = {r["rule"]: r["firing"] for r in H.health_rules(spark.createDataFrame([("speed_batch_drift", "", -0.2)], "metric string, label string, value double")).collect()}
    assert rule["SpeedBatchDriftHigh"]


def test_open_alerts_count_for_active_vehicles_only(spark):
    now = dt.datetime(2024, 1, 1, 12)
    state = spark.createDataFrame([("V001", "idle", "Z01", now), ("V002", "idle", "Z01", now - dt.timedelta(hours=2))], "vehicle_id string, status string, zone_id string, event_time timestamp_ntz")
    alerts = spark.createDataFrame([("V001", True, "open"), ("V002", True, "open")], "vehicle_id string, alert boolean, status string")
    r = S.fleet_live(state, state.agg(F.max("event_time").alias("now")), alerts).first()
    assert (r["active"], r["idle"], r["open_alerts"], r["idle_ratio"], r["as_of"]) == (1, 1, 1, 1.0, now)


LINES = "sim_date string, version int, line_no long, date string, vehicle_id string, fuel_cost string, maintenance_cost string, distance_covered string, service_flag string"


def line(n, vehicle="V001", fuel="10"):
    return (D, 1, n, D, vehicle, fuel, "5", "100", "false")


def test_empty_file_is_refused_and_strict_mode_raises(spark):
    roster = spark.createDataFrame([(f"V{i:03d}",) for i in range(1, 11)], "vehicle_id string")
    lines = spark.createDataFrame([line(i, f"V{i:03d}", "x" if i <= 2 else "1") for i in range(1, 11)], LINES)
    files = spark.createDataFrame([(D, 1), ("2024-01-02", 1)], "sim_date string, version int")
    gated = E.gate(lines, roster, files=files)
    assert {r["sim_date"]: (r["invalid_ratio"], r["accepted"]) for r in gated.collect()} == {D: (0.2, True), "2024-01-02": (None, False)}
    assert E.strict(gated.where(F.col("sim_date") == D)).first()["accepted"]
    with pytest.raises(PySparkException, match="no rows"):
        E.strict(gated).collect()


def test_quarantine_of_a_repeated_run_replaces_its_own_rows(spark, tmp_path):
    roster = spark.createDataFrame([("V001",)], "vehicle_id string")
    lines = spark.createDataFrame([line(1), line(2), line(3, "V009"), line(4, "V001", "")], LINES)
    root = f"file://{tmp_path}/dq"
    for run in ("r1", "r1", "r2"):
        jobs.quarantine(E.quarantined(lines, roster, F.lit(run)), root)
    got = spark.read.parquet(root)
    assert {r["run_id"]: r["count"] for r in got.groupBy("run_id").count().collect()} == {"r1": 3, "r2": 3}
    assert {r["reason"] for r in got.collect()} == {"duplicate", "unknown_vehicle"}


def test_run_log_merges_entries(spark, tmp_path):
    root, at = f"file://{tmp_path}/runs", lambda m: F.expr(f"timestamp_ntz'2024-01-02 00:{m:02d}:00'")
    H.append_runs(H.run_started(spark, "r1", D, 2, at(1), late=True), root)
    H.append_runs(H.task_took(spark, "r1", "validate", 1.5, at(2)), root)
    H.append_runs(H.task_took(spark, "r1", "load", 0.25, at(3)), root)
    H.append_runs(H.run_finished(spark, "r1", "success", at(4), quarantined=3), root)
    H.append_runs(H.run_started(spark, "r2", D, 3, at(5)), root)
    H.append_runs(H.run_finished(spark, "r2", "failed", at(6), notes="broken file"), root)
    runs = H.run_log_latest(H.run_log(spark, root))
    r = {x["run_id"]: x for x in runs.collect()}
    assert (r["r1"]["status"], r["r1"]["late"], r["r1"]["quarantined"], r["r1"]["durations"], r["r2"]["status"]) == ("success", True, 3, {"validate": 1.5, "load": 0.25}, "failed")
    assert [tuple(x) for x in H.processed_versions(runs).collect()] == [(D, 2)]


def test_archive_day_reads_one_partition_and_guards_the_date(spark, tmp_path):
    root = f"file://{tmp_path}/archive"
    rows = [("a", dt.datetime(2024, 1, 1, 9), D), ("b", dt.datetime(2024, 1, 2, 0), D), ("c", dt.datetime(2024, 1, 2, 5), "2024-01-02"), ("d", None, "unknown")]
    spark.createDataFrame(rows, "event_id string, event_time timestamp_ntz, sim_date string").write.partitionBy("sim_date").parquet(root)
    archive = spark.read.schema("event_id string, event_time timestamp_ntz, sim_date string").parquet(root)
    assert [r["event_id"] for r in T.of_date(archive, D).collect()] == ["a"]
    assert T.of_date(archive, "2024-02-01").count() == 0
    assert {r["event_id"] for r in T.guarded(archive).collect()} == {"a", "c", "d"}
    plan = T.of_date(archive, D)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sim_date" in plan


def test_percent_takes_halves_by_decimal_digits(spark):
    df = spark.createDataFrame([(0, 0.0045), (1, -0.0045), (2, 0.0185), (3, 0.0044), (4, -0.0003)], "i int, b double")
    assert [r[0] for r in df.orderBy("i").select(X.percent(F.col("b"))).collect()] == ["0.5%", "-0.5%", "1.9%", "0.4%", "-0.0%"]


def test_ratios_that_are_ties_are_rounded_as_in_sql(spark):
    x = abs(689.766 - 264.0) / 264.0
    df = spark.createDataFrame([(x,), (-x,), (0.12346,), (0.0,)], "x double")
    assert [r[0] for r in df.select(X.round_ratio(F.col("x"))).collect()] == [1.6127, -1.6127, 0.1235, 0.0]
