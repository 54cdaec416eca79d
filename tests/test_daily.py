"""The versioned table and the daily job."""

import datetime as dt
import random
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayledger.operators import expenses as E
from wayledger.operators import health as H
from wayledger.operators import telemetry as T
from wayledger.plans import daily
from wayledger.sources import landing
from wayledger.sources.snapshots import Conflict, Snapshots

SMALL = "sim_date string, vehicle_id string, x int"


def rows(spark, *found):
    return spark.createDataFrame(list(found), SMALL)


def values(df):
    return sorted(tuple(r) for r in df.select("sim_date", "vehicle_id", "x").collect())


def test_versions_stay_readable_and_a_date_without_rows_ends_up_empty(spark, tmp_path):
    t = Snapshots(spark, f"file://{tmp_path}/t", SMALL)
    assert (t.versions(), values(t.read())) == ([], [])
    assert t.replace(rows(spark, ("d1", "a", 1), ("d2", "a", 2), ("d3", "a", 3)), ["d1", "d2"], "r1") == 1
    assert t.replace(rows(spark, ("d2", "a", 9)), ["d1", "d2"], "r2", {"s": rows(spark, ("d", "s", 1))}) == 2
    assert values(t.read(1)) == [("d1", "a", 1), ("d2", "a", 2)]
    assert values(t.read()) == [("d2", "a", 9)]
    assert values(t.read(1, ["d2", "d7"])) == [("d2", "a", 2)]
    assert (values(t.side("s", SMALL)), values(t.side("s", SMALL, 1)), t.manifest()["run_id"]) == ([("d", "s", 1)], [], "r2")


def test_a_reader_during_a_replace_sees_the_old_version_whole(spark, tmp_path):
    """Also where the writer dies between its folders and the manifest."""
    t = Snapshots(spark, f"file://{tmp_path}/t", SMALL)
    t.replace(rows(spark, ("d1", "a", 1), ("d2", "a", 1)), ["d1", "d2"], "r1")
    reader = t.read()
    seen = []
    publish = Snapshots._publish

    class Watched(Snapshots):
        def _publish(self, entry):
            seen.append(values(t.read()))
            if entry["run_id"] == "dies":
                raise RuntimeError("gone")
            return publish(self, entry)

    w = Watched(spark, t.root, SMALL)
    with pytest.raises(RuntimeError):
        w.replace(rows(spark, ("d1", "a", 5), ("d2", "a", 5)), ["d1", "d2"], "dies")
    old = [("d1", "a", 1), ("d2", "a", 1)]
    assert (values(t.read()), t.versions()) == (old, [1])
    w.replace(rows(spark, ("d1", "a", 2), ("d2", "a", 2)), ["d1", "d2"], "r2")
    assert seen == [old, old] and values(reader) == old and values(t.read()) == [("d1", "a", 2), ("d2", "a", 2)]


def test_commits_of_other_dates_are_kept_and_of_the_same_refused(spark, tmp_path):
    t = Snapshots(spark, f"file://{tmp_path}/t", SMALL)
    t.replace(rows(spark, ("d1", "a", 1)), ["d1"], "r1")
    t.replace(rows(spark, ("d2", "a", 1)), ["d2"], "r2", based_on=1)
    assert t.replace(rows(spark, ("d3", "a", 1)), ["d3"], "r3", based_on=1) == 3
    with pytest.raises(Conflict):
        t.replace(rows(spark, ("d2", "a", 7)), ["d2"], "r4", based_on=1)
    assert values(t.read()) == [("d1", "a", 1), ("d2", "a", 1), ("d3", "a", 1)]


def test_expire_deletes_only_what_no_kept_version_holds(spark, tmp_path):
    t = Snapshots(spark, f"file://{tmp_path}/t", SMALL)
    for x in range(4):
        t.replace(rows(spark, ("d1", "a", x), ("d2", "a", x)), ["d1", "d2"] if x == 0 else ["d1"], f"r{x}", {"s": rows(spark, ("d", "s", x))})
    before = values(t.read())
    assert t.expire(2) > 0
    assert (t.versions(), values(t.read()), values(t.read(3)), t.expire(2)) == ([3, 4], before, [("d1", "a", 2), ("d2", "a", 0)], 0)


def curated(spark, found):
    """Rows of (date, vehicle, net profit) with the table's other columns."""
    base = spark.createDataFrame(found, "sim_date string, vehicle_id string, net_profit double")
    kinds = dict(c.split(" ") for c in daily.CURATED.split(", "))
    return base.select(*[F.col(c) if c in base.columns else (F.lit(False) if kinds[c] == "boolean" else F.lit("r" if kinds[c] == "string" else 0)).cast(kinds[c]).alias(c) for c in daily.COLUMNS])


def test_day_by_day_and_restated_dates_equal_all_at_once(spark, tmp_path):
    """Vehicles with gaps, vehicles that come and go, dates in any order, and restatements that
    add, drop and change rows."""
    rng = random.Random(1)
    dates = [f"2024-01-{i:02d}" for i in range(1, 11)]
    fresh = lambda d, share: [(d, f"V{v}", float(rng.randint(-3, 3))) for v in range(6) if rng.random() < share] + [(d, "V7", -1.0)]
    held, t = {}, Snapshots(spark, f"file://{tmp_path}/t", daily.CURATED)
    first = dates[:5] + [dates[6], dates[5]] + dates[7:]
    for n, d in enumerate([*first, dates[2], dates[8], dates[0]]):
        held[d] = fresh(d, 0.55)
        daily.replace_date(t, curated(spark, held[d]), d, f"r{n}")
    every = curated(spark, [r for d in dates for r in held[d]])
    flags = lambda df: sorted((r["sim_date"], r["vehicle_id"], r["net_profit"], r["becoming_unprofitable"]) for r in df.collect())
    assert flags(t.read()) == flags(E.with_trend(every))
    spans = lambda df: sorted((tuple(r) for r in df.select("vehicle_id", "first_date", "last_date", "last_net", "before_net").collect()), key=str)
    assert spans(t.side("summary", daily.SUMMARY).where("last_date IS NOT NULL")) == spans(daily.summarised(every))


def test_a_restated_date_reads_few_dates_however_long_the_history(spark, tmp_path, monkeypatch):
    t = Snapshots(spark, f"file://{tmp_path}/t", daily.CURATED)
    dates = [f"2024-{m:02d}-{d:02d}" for m in (1, 2) for d in range(1, 21)]
    t.replace(curated(spark, [(d, v, 1.0) for d in dates for v in ("V1", "V2")]), dates, "r", {"summary": daily.summarised(curated(spark, [(d, v, 1.0) for d in dates for v in ("V1", "V2")]))})
    asked = []
    read = Snapshots.read
    monkeypatch.setattr(Snapshots, "read", lambda self, version=None, dates=None: asked.append(dates) or read(self, version, dates))
    daily.replace_date(t, curated(spark, [(dates[20], "V1", -5.0), (dates[20], "V2", 1.0)]), dates[20], "again")
    assert len({d for a in asked for d in a}) == 5 and max(map(len, asked)) <= 2


LINES = "sim_date string, version int, line_no long, date string, vehicle_id string, fuel_cost string, maintenance_cost string, distance_covered string, service_flag string"


def lines(spark, version, date, costs):
    return spark.createDataFrame([(date, version, i, date, v, c, "5", "100", "false") for i, (v, c) in enumerate(costs)], LINES)


def stores(spark, root):
    roster = spark.createDataFrame([(f"V{i}",) for i in range(1, 6)], "vehicle_id string")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in T.archived(spark.createDataFrame([], "value string, kafka_offset long, arrival_time timestamp_ntz")).schema.fields)
    return daily.Stores(spark, f"{root}/archive", schema, f"{root}/landing", Snapshots(spark, f"{root}/table", daily.CURATED), f"{root}/dq", f"{root}/runs", f"{root}/reports", roster)


def test_runs_of_good_bad_empty_and_missing_files(spark, tmp_path):
    """No archive at all: every vehicle that was billed has no telemetry."""
    s, clock = stores(spark, f"file://{tmp_path}"), iter(range(100))
    at = lambda: F.lit(dt.datetime(2024, 2, 1) + dt.timedelta(minutes=next(clock))).cast("timestamp_ntz")
    good, bad = [(f"V{i}", "10") for i in range(1, 6)], [("V1", "10"), ("V2", ""), ("V3", "-1"), ("V9", "1"), ("V1", "3")]
    files = (lines(spark, 1, "2024-01-01", good), lines(spark, 1, "2024-01-02", bad), lines(spark, 2, "2024-01-01", good[:4]))
    landing.land(reduce(DataFrame.unionByName, files), s.landing)
    assert daily.run_pending(s, F.expr("timestamp_ntz'2024-02-01 00:00:00'"), at) == [("2024-01-01", 2, "success"), ("2024-01-02", 1, "failed")]
    assert daily.run_date(s, "2024-01-07", 1, "none", at) == "failed"
    got = s.table.read().collect()
    assert {(r["sim_date"], r["vehicle_id"], r["expense_file_version"], r["run_id"], r["missing_telemetry"], r["net_profit"]) for r in got} == {("2024-01-01", f"V{i}", 2, "2024-01-01_v2", True, -15.0) for i in range(1, 5)}
    log = {r["run_id"]: r for r in H.run_log_latest(daily.run_log(s)).collect()}
    assert {k: (r["status"], r["version"], r["quarantined"]) for k, r in log.items()} == {"2024-01-01_v2": ("success", 2, 0), "2024-01-02_v1": ("failed", 1, 4), "none": ("failed", 1, None)}
    assert set(log["2024-01-01_v2"]["durations"]) == {"validate", "reconcile", "replace", "report"}
    notes = {r["run_id"]: r["notes"] for r in daily.run_log(s).where("notes IS NOT NULL").collect()}
    assert "80.0%" in notes["2024-01-02_v1"] and "no expense file" in notes["none"]
    assert spark.read.parquet(s.quarantine).groupBy("run_id").count().collect()[0]["count"] == 4
    # The refused file stays pending; the good one doesn't.
    assert daily.run_pending(s, F.expr("timestamp_ntz'2024-02-01 00:00:00'"), at) == [("2024-01-02", 1, "failed")]
    assert len(s.table.versions()) == 1


def test_an_error_is_logged_as_a_failure_and_raised(spark, tmp_path, monkeypatch):
    s = stores(spark, f"file://{tmp_path}")
    landing.land(lines(spark, 1, "2024-01-01", [("V1", "10")]), s.landing)
    monkeypatch.setattr(daily, "replace_date", lambda *_: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError, match="disk"):
        daily.run_date(s, "2024-01-01", 1, "r1")
    r = H.run_log_latest(daily.run_log(s)).first()
    assert (r["status"], s.table.versions()) == ("failed", [])


def test_ids_count_once_a_day_and_again_on_another(spark):
    """Also when all dates are read at once, and for an id that two vehicles share in a day."""
    schema = "event_id string, event_type string, trip_id string, driver_id string, vehicle_id string, lat double, lon double, speed double, status string, fare double, timestamp string, schema_version int, event_time timestamp_ntz, raw_value string, kafka_offset long, arrival_time timestamp_ntz, sim_date string"

    def event(key, day, hour, minute, vehicle="V9", offset=0):
        at = dt.datetime(2024, 3, day, hour, minute)
        return (key, "trip_end", None, "D9", vehicle, 13.0, 77.55, 5.0, "on_trip", 100.0, "t", 1, at, "{}", offset, at, f"2024-03-{day:02d}")

    found = [event("a", 1, 23, 59), event("a", 2, 0, 1), event("b", 2, 5, 0), event("b", 2, 5, 0, offset=1), event("c", 2, 6, 0, "V8", 2), event("c", 2, 6, 1, "V9", 3)]
    archive = spark.createDataFrame(found, schema)
    every = {(r["sim_date"], r["vehicle_id"]): r["trips"] for r in T.vehicle_day(archive).collect()}
    assert every == {("2024-03-01", "V9"): 1, ("2024-03-02", "V9"): 2, ("2024-03-02", "V8"): 1}
    one = {(r["sim_date"], r["vehicle_id"]): r["trips"] for r in T.vehicle_day(T.of_date(archive, "2024-03-02")).collect()}
    assert one == {k: v for k, v in every.items() if k[0] == "2024-03-02"}
    events = T.clustered(archive, 3)
    left = events.join(T.shared(events), ["sim_date", "event_id", "vehicle_id"], "left_anti")
    assert sorted(map(tuple, left.select("event_id", "vehicle_id", "kafka_offset", "sim_date").collect())) == sorted(map(tuple, T.clean(archive).select("event_id", "vehicle_id", "kafka_offset", "sim_date").collect()))


def test_figures_of_clustered_events_need_no_exchange(spark, tmp_path):
    from wayledger.sources import clustered

    rows_ = [(f"V{i % 5}", dt.datetime(2024, 1, 1 + i % 3, 1 + i % 20), f"e{i}", "ping", 0.0, 13.0, 77.6, "idle", f"2024-01-{1 + i % 3:02d}") for i in range(60)]
    df = spark.createDataFrame(rows_, "vehicle_id string, event_time timestamp_ntz, event_id string, event_type string, fare double, lat double, lon double, status string, sim_date string")
    root = f"file://{tmp_path}/c"
    name = clustered.write(df.repartition(4, "vehicle_id"), root, 4)
    again = clustered.describe(spark, root, ", ".join(f"{c} {k}" for c, k in df.dtypes), 4)
    for table in (name, again):
        figures = T.day_figures(spark.table(table))
        plan = figures._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and figures.count() == 15
    one = spark.table(name).where("sim_date = '2024-01-02'")
    assert "PartitionFilters: [isnotnull(sim_date" in one._jdf.queryExecution().executedPlan().toString()
