"""Idle spells folded day by day, and rules that fire after their hold time."""

import datetime as dt
import random

from pyspark.sql import functions as F

from wayledger.operators import rules as R
from wayledger.operators import spells as K
from wayledger.operators import telemetry as T

EVENT = "vehicle_id string, event_time timestamp_ntz, event_id string, status string, sim_date string"


def test_spells_of_days_equal_those_of_all_at_once(spark):
    """Spells over several midnights, days without events, vehicles that come late."""
    rng = random.Random(11)
    rows = []
    for v in range(8):
        at, status = dt.datetime(2024, 1, 1, rng.randrange(24)), "idle"
        for n in range(70):
            at += dt.timedelta(minutes=rng.choice((1, 20, 44, 46, 200, 1900)))
            status = status if rng.random() < 0.6 else rng.choice(("idle", "on_trip"))
            if at < dt.datetime(2024, 1, 9):
                rows.append((f"V{v}", at, f"{v}-{n:03d}", status, at.strftime("%Y-%m-%d")))
    events = spark.createDataFrame(rows, EVENT)
    carried, closed = spark.createDataFrame([], K.CARRIED), []
    for d in range(1, 9):
        folded = K.fold_day(carried, events.where(F.col("sim_date") == f"2024-01-{d:02d}")).collect()
        closed += [tuple(r) for r in folded if r["status"] == "closed"]
        carried = K.open_spells(spark.createDataFrame(folded, K.SPELL))
    left = [tuple(r) for r in K.fold_day(carried, events.limit(0)).collect()]
    every = [tuple(r) for r in T.idle_islands(events).select(*[c.split(" ")[0] for c in K.SPELL.split(", ")]).collect()]
    assert sorted(closed + left, key=str) == sorted(every, key=str)
    assert any(r[1].date() < r[3].date() for r in every)


def test_silence_ends_a_spell_where_asked(spark):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    events = spark.createDataFrame([("V1", at(1, 0), "a", "idle", "d"), ("V1", at(1, 30), "b", "idle", "d"), ("V1", at(4, 0), "c", "idle", "d"), ("V1", at(4, 10), "e", "on_trip", "d")], EVENT)
    whole = [(r["idle_since"], r["closed_at"], r["alert"]) for r in T.idle_islands(events).collect()]
    cut = sorted((r["idle_since"], r["closed_at"], r["idle_min"], r["alert"]) for r in T.idle_islands(events, silence_minutes=60).collect())
    assert whole == [(at(1, 0), at(4, 10), True)]
    assert cut == [(at(1, 0), at(1, 30), 30.0, False), (at(4, 0), at(4, 10), 10.0, False)]


def test_a_rule_waits_fires_and_resolves(spark):
    """Hold times by step, a condition that ends too soon, labels apart, a change on the last step."""
    grid = R.Grid(spark, "2024-01-01 00:00:00", "2024-01-01 05:00:00", step=15, minute=15)
    holds = {"a": "0011110010000000000011", "b": "1" * 21 + "0"}
    rows = [("X", label, n, float(n), c == "1") for label, text in holds.items() for n, c in enumerate(text)]
    found = R.states(grid, spark.createDataFrame(rows, "rule string, label string, n long, value double, holds boolean"), [("X", "warning", 2)])
    got = [(r["label"], (r["at"] - dt.datetime(2024, 1, 1)).seconds // 900, r["change"]) for r in R.transitions(found).orderBy("label", "at").collect()]
    assert got == [("a", 2, "pending"), ("a", 4, "firing"), ("a", 6, "resolved"), ("a", 8, "pending"), ("a", 9, "dropped"), ("a", 20, "pending"), ("b", 0, "pending"), ("b", 2, "firing"), ("b", 21, "resolved")]
    assert [tuple(r) for r in R.now(found).collect()] == [("X", "warning", False, 21.0)]


def test_windows_and_held_gauges(spark):
    grid = R.Grid(spark, "2024-01-01 00:00:00", "2024-01-01 01:00:00", step=10, minute=10)
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    events = spark.createDataFrame([(at(0),), (at(10),), (at(11),), (at(12),), (None,)], "at timestamp_ntz")
    rows = lambda df: [r["value"] for r in df.orderBy("label", "n").collect()]
    assert rows(R.counted(grid, events, "at")) == [1, 1, 2, 0, 0, 0, 0]
    assert rows(R.increase(R.counted(grid, events, "at"), 2)) == [1, 2, 3, 2, 0, 0, 0]
    gauge = spark.createDataFrame([("", at(15), 3.0), ("", at(18), 4.0), ("", at(40), 0.0)], "label string, at timestamp_ntz, value double")
    assert rows(R.held(grid, gauge)) == [None, None, 4.0, 4.0, 0.0, 0.0, 0.0]


def test_backlog_equals_reading_step_by_step(spark):
    rng = random.Random(2)
    rows, want = [], []
    for label in "xy":
        behind = 0
        for n in range(60):
            came = rng.choice((0, 0, 1, 7, 20))
            read = min(5, behind + came)
            behind += came - read
            rows.append((label, n, came))
            want.append((label, n, read, behind))
    got = R.backlog(spark.createDataFrame(rows, "label string, n long, value long"), 5).orderBy("label", "n")
    assert [(r["label"], r["n"], r["read"], r["behind"]) for r in got.collect()] == want
