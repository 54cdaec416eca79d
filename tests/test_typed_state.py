"""The vehicle fold on typed state: the same as the grouped state, and from the batch layer on."""

import inspect

from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from wayledger.plans import queries
from wayledger.streaming import jobs, vehicles

SF, CUT = "/root/testdata/sf0.001", "2024-01-04"


def test_typed_state_and_a_restart_give_the_same_states_and_alerts(spark):
    f = queries.Fleet(spark, SF)
    rows = lambda df: sorted(map(str, df.collect()))
    states, alerts = jobs.run_vehicle_state(f.wire)
    typed, shown, stored = vehicles.run(f.wire)
    assert (rows(typed), rows(shown)) == (rows(states), rows(alerts))
    live = states.where("status != 'offline'").select("vehicle_id", "status", "zone_id", F.col("event_time").cast("timestamp_ntz").alias("seen"))
    assert rows(stored.select("vehicle_id", "status", "zone_id", "seen")) == rows(live)
    initial = vehicles.batch_states(f.clean.where(F.col("sim_date") < CUT))
    again, later, _ = vehicles.run(f.wire.where(F.col("sent_at") >= CUT), initial)
    assert rows(again) == rows(states)
    key = lambda df: rows(df.where(F.col("closed_at").isNull() | (F.col("closed_at") >= CUT)).select("vehicle_id", "opened_at", "closed_at", "status", "idle_min"))
    assert key(later) == key(alerts) and initial.count() > 0


def test_batch_states_leave_out_the_silent_and_keep_the_open_spell(spark):
    schema = "vehicle_id string, driver_id string, status string, zone_id string, trip_id string, lat double, lon double, speed double, event_time timestamp_ntz, event_id string"
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 8) + dt.timedelta(minutes=m)
    row = lambda v, m, status: (v, "D", status, "Z01", None, 13.0, 77.6, 0.0, at(m), f"{v}{m}")
    events = spark.createDataFrame([row("V1", 0, "on_trip"), *[row("V2", m, "idle") for m in range(0, 61, 10)], row("V3", 58, "enroute")], schema)
    got = {r["vehicle_id"]: (r["status"], r["idle_since"], r["opened_at"]) for r in vehicles.batch_states(events).select("vehicle_id", "status", F.col("idle_since").cast("timestamp_ntz"), F.col("opened_at").cast("timestamp_ntz")).collect()}
    assert got == {"V2": ("idle", at(0), at(50)), "V3": ("enroute", None, None)}


def test_the_processor_names_its_parameters_as_spark_passes_them():
    for name in ("handleInputRows", "handleExpiredTimer", "handleInitialState"):
        assert [*inspect.signature(getattr(vehicles.VehicleProcessor, name)).parameters] == [*inspect.signature(getattr(StatefulProcessor, name)).parameters]
