import datetime as dt

import pytest
from pyspark.sql import functions as F

from wayledger.operators import health as H
from wayledger.operators import telemetry as T
from wayledger.plans import queries
from wayledger.plans.recompute import recompute
from wayledger.sources import landing
from wayledger.streaming import monitor

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1, 8)


def after(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_listing_takes_plain_files_and_folders_and_nothing_else(spark, tmp_path):
    line = "date,vehicle_id,fuel_cost,maintenance_cost,distance_covered,service_flag\n2024-01-01,V001,1,2,3,true\n"
    for name in ("expenses_2024-01-01_v1.csv", "expenses_2024-01-01_v12.csv", "notes.csv"):
        (tmp_path / name).write_text(line)
    root = f"file://{tmp_path}"
    assert [(r["sim_date"], r["version"]) for r in landing.newest(landing.listing(spark, root)).collect()] == [("2024-01-01", 12)]
    assert {r["version"] for r in landing.expense_files(spark, root).collect()} == {1, 12}


def test_missing_landing_folder_has_no_files(spark, tmp_path):
    assert landing.listing(spark, f"file://{tmp_path}/none").count() == 0


def test_late_counts_first_versions_only(spark):
    rows = [("2024-01-01", 1, dt.datetime(2024, 1, 2, 2, 0)), ("2024-01-02", 1, dt.datetime(2024, 1, 3, 2, 1)), ("2024-01-03", 2, dt.datetime(2024, 1, 9))]
    got = landing.late(spark.createDataFrame(rows, "sim_date string, version int, arrived_at timestamp_ntz"))
    assert [r["sim_date"] for r in got.collect()] == ["2024-01-02"]


LOG = "run_id string, sim_date string, at timestamp_ntz, status string, late boolean, quarantined long, durations map<string,double>"


def test_run_log_merges_durations_and_keeps_the_last_status(spark):
    rows = [("r", "2024-01-01", after(0), "running", None, None, {"a": 1.0}), ("r", None, after(5), "success", False, 3, {"b": 2.0}), ("r", None, after(6), None, None, None, {"a": 4.0}), ("s", "2024-01-02", after(0), "running", None, None, None)]
    got = {r["run_id"]: r for r in H.run_log_latest(spark.createDataFrame(rows, LOG)).collect()}
    assert (got["r"]["status"], got["r"]["sim_date"], got["r"]["finished_at"], got["r"]["durations"]) == ("success", "2024-01-01", after(5), {"a": 4.0, "b": 2.0})
    assert (got["s"]["status"], got["s"]["finished_at"], got["s"]["durations"]) == ("running", None, None)


def test_alerts_default_name_and_zero_time(spark):
    text = '{"alerts":[{"status":"firing","labels":{"severity":"warning"},"startsAt":"2024-01-01T08:00:00Z","endsAt":"0001-01-01T00:00:00Z"},{"status":"resolved","labels":{"alertname":"A"},"startsAt":"2xx"}]}'
    df = spark.createDataFrame([(text,), ("not json",), ("{}",), (None,)], "payload string")
    got = [(r["alertname"], r["starts_at"], r["ends_at"]) for r in H.alert_rows(df).orderBy("status").collect()]
    assert got == [("unknown", T0, None), ("A", None, None)]


@pytest.mark.parametrize(("now", "expect"), [(60, {"dead": "inactive"}), (130, {"dead": "inactive", "mute": "no_progress"}), (500, {"dead": "inactive", "mute": "no_progress", "ok": "silent"})])
def test_stalled(spark, now, expect):
    launched = spark.createDataFrame([("ok", T0, True), ("mute", T0, True), ("dead", T0, False)], "query string, started_at timestamp_ntz, active boolean")
    progress = spark.createDataFrame([("ok", after(50)), ("dead", after(59))], "query string, at timestamp_ntz")
    clock = spark.createDataFrame([(after(now),)], "now timestamp_ntz")
    assert {r["query"]: r["reason"] for r in H.stalled(launched, progress, clock).collect()} == expect


def test_rules_fire_on_the_worst_label_and_not_without_a_metric(spark):
    df = spark.createDataFrame([("offsets_behind", "a", 1.0), ("offsets_behind", "b", 5001.0), ("dlq_rate", "", 0.02), ("telemetry_events", "", 0.0)], "metric string, label string, value double")
    assert {r["rule"] for r in H.health_rules(df).where("firing").collect()} == {"StreamLagHigh", "TelemetryNotProduced"}


def test_no_runs_give_flags_of_zero(spark):
    runs = H.run_log_latest(spark.createDataFrame([], LOG))
    drift = spark.createDataFrame([], "sim_date string, drift_ratio double")
    got = H.batch_metrics(runs, drift, spark.createDataFrame([(0,)], "open_alerts long"))
    assert {r["metric"]: r["value"] for r in got.collect()} == {"expense_file_late": 0.0, "batch_run_failed": 0.0, "open_idle_alerts": 0.0}


def test_recompute_rewrites_new_dates_and_what_looks_back_at_them(spark, tmp_path):
    f = queries.Fleet(spark, "/root/testdata/sf0.01")
    root, clock = f"file://{tmp_path}/t", F.expr("timestamp_ntz'2024-01-06 12:00:00'")
    none = spark.createDataFrame([], "sim_date string, processed_version int")
    first = recompute(root, f.days, f.landed, f.roster, none, clock)
    assert first == ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-05"]
    done = spark.createDataFrame([("2024-01-01", 2), ("2024-01-02", 1), ("2024-01-03", 2), ("2024-01-05", 1)], none.schema)
    assert recompute(root, f.days, f.landed, f.roster, done, clock) == []
    before = sorted(map(repr, spark.read.parquet(root).collect()))
    assert recompute(root, f.days, f.landed, f.roster, done, clock, forced=["2024-01-02"]) == ["2024-01-02", "2024-01-03", "2024-01-05"]
    assert sorted(map(repr, spark.read.parquet(root).collect())) == before


def test_progress_of_all_streams(spark):
    f = queries.Fleet(spark, SF)
    root, progress, life = monitor.run_all(f.wire)
    got = {r["query"]: r for r in monitor.late_rows(progress).collect()}
    assert set(got) == {"intake", "dedup", "zone_hourly", "vehicle_daily", "vehicle_state"}
    assert {r["input_rows"] for r in got.values()} == {f.wire.count()}
    left = {r["query"]: r["rows"] for r in monitor.outputs(spark, root).collect()}
    assert left["archive"] == f.wire.count() and left["dlq"] + T.valid(f.raw).count() == left["archive"]
    assert all(r["last_at"] for r in monitor.freshness(progress).collect())
