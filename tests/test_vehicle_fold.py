"""The per-vehicle fold, driven with a state of its own."""

import datetime as dt

import pandas as pd
import pytest

from wayledger.params import DEFAULT
from wayledger.streaming import jobs

T0 = pd.Timestamp("2024-01-01 08:00:00")


class State:
    """What Spark hands to the fold: a tuple, a watermark and a timeout."""

    def __init__(self, held=None, timed_out=False):
        self.held, self.hasTimedOut, self.removed, self.timeout = held, timed_out, False, None

    @property
    def exists(self):
        return self.held is not None

    @property
    def get(self):
        return self.held

    def update(self, held):
        self.held = held

    def remove(self):
        self.held, self.removed = None, True

    def getCurrentWatermarkMs(self):
        return 0

    def setTimeoutTimestamp(self, at):
        self.timeout = at


def events(*steps):
    rows = [(f"e{m}-{i}", T0 + pd.Timedelta(minutes=m), "D001", status, "Z06", 12.98, 77.6, 10.0, None) for i, (m, status) in enumerate(steps)]
    return pd.DataFrame(rows, columns=["event_id", "event_time", "driver_id", "status", "zone_id", "lat", "lon", "speed", "trip_id"])


def fold(state, *steps):
    frames = [events(*steps)] if steps else []
    return [r for f in jobs.fold_vehicle(("V001",), iter(frames), state) for r in f.to_dict("records")]


def at(minutes):
    return T0 + pd.Timedelta(minutes=minutes)


def test_alert_opens_at_45_not_before():
    state = State()
    assert [r["change"] for r in fold(state, (0, "idle"), (44, "idle"))] == ["none"]
    opened, left = fold(state, (45, "idle"))
    assert (opened["change"], opened["opened_at"], opened["idle_min"]) == ("opened", at(45), 45.0)
    assert (left["change"], left["opened_at"], left["idle_since"]) == ("none", at(45), at(0))


def test_open_alert_is_not_opened_again():
    state = State()
    fold(state, (0, "idle"), (45, "idle"))
    assert [(r["change"], r["opened_at"]) for r in fold(state, (55, "idle"))] == [("none", at(45))]


def test_closing_reports_the_minutes_until_the_vehicle_moved():
    state = State()
    fold(state, (0, "idle"), (45, "idle"))
    closed, left = fold(state, (50, "enroute"))
    assert (closed["change"], closed["idle_min"], closed["opened_at"], closed["closed_at"]) == ("closed", 50.0, at(45), at(50))
    assert (left["status"], left["opened_at"], left["idle_min"]) == ("enroute", None, 0.0) or pd.isna(left["opened_at"])


def test_open_and_close_within_one_batch_are_two_rows():
    assert [r["change"] for r in fold(State(), (0, "idle"), (45, "idle"), (50, "on_trip"), (60, "idle"), (110, "idle"))] == ["opened", "closed", "opened", "none"]


def test_clock_restarts_after_a_trip():
    state = State()
    fold(state, (0, "idle"), (10, "on_trip"))
    assert fold(state, (20, "idle"), (30, "idle"))[-1]["idle_min"] == 10.0


def test_events_fold_in_order_of_time():
    assert fold(State(), (30, "idle"), (0, "idle"), (15, "idle"))[-1]["idle_min"] == 30.0


def test_stale_event_does_not_rewind():
    state = State()
    fold(state, (0, "idle"), (40, "idle"))
    left = fold(state, (5, "on_trip"))[-1]
    assert (left["status"], left["idle_min"], left["event_time"]) == ("idle", 40.0, at(40))


def test_timeout_is_set_and_makes_the_vehicle_offline():
    state = State()
    fold(state, (0, "on_trip"))
    assert state.timeout == int((at(DEFAULT.offline_min)).timestamp() * 1000)
    state.hasTimedOut = True
    (left,) = fold(state)
    assert (left["status"], left["speed"], left["change"], state.removed) == ("offline", 0.0, "none", True)


def test_timeout_closes_an_open_alert_at_its_last_event():
    state = State()
    fold(state, (0, "idle"), (50, "idle"))
    state.hasTimedOut = True
    closed, left = fold(state)
    assert (closed["change"], closed["idle_min"], closed["closed_at"]) == ("closed", 50.0, at(50))
    assert left["status"] == "offline" and pd.isna(left["opened_at"])


def test_rows_and_state_have_the_declared_columns():
    state = State()
    (frame,) = jobs.fold_vehicle(("V001",), iter([events((0, "idle"))]), state)
    assert list(frame.columns) == [c.split()[0] for c in jobs.STATE_OUT.split(", ")]
    assert len(state.held) == len(jobs.STATE.split(", ")) == len(jobs.FIELDS)


@pytest.mark.parametrize("cuts", [[], [3], [1, 2, 4, 6]])
def test_batches_do_not_change_what_is_reported(cuts):
    steps = [(0, "idle"), (15, "idle"), (30, "idle"), (46, "idle"), (52, "on_trip"), (60, "idle"), (75, "idle"), (106, "idle")]
    state, changes = State(), []
    for lo, hi in zip([0, *cuts], [*cuts, len(steps)], strict=True):
        changes += [(r["change"], r["opened_at"], r["idle_min"]) for r in fold(state, *steps[lo:hi]) if r["change"] != "none"]
    assert changes == [("opened", at(46), 46.0), ("closed", at(46), 52.0), ("opened", at(106), 46.0)]


def test_fold_agrees_with_the_batch_islands(spark):
    from wayledger.operators import telemetry as T

    steps = [(0, "idle"), (15, "idle"), (30, "idle"), (46, "idle"), (52, "on_trip"), (60, "idle"), (75, "idle"), (106, "idle")]
    rows = [("V001", f"e{m}", (T0 + dt.timedelta(minutes=m)).to_pydatetime(), s) for m, s in steps]
    got = T.idle_islands(spark.createDataFrame(rows, "vehicle_id string, event_id string, event_time timestamp_ntz, status string")).orderBy("idle_since").collect()
    assert [(r["opened_at"], r["closed_at"], r["idle_min"], r["status"]) for r in got] == [(at(46), at(52), 52.0, "closed"), (at(106), None, 46.0, "open")]
