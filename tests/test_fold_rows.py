"""The vehicle fold gives what a walk over its events one by one gives, batch after batch, and
looks at few of them as a whole."""

import random

import pandas as pd

from wayledger.streaming import jobs

T0 = pd.Timestamp("2024-01-01 08:00:00")


class State:
    def __init__(self):
        self.get, self.exists, self.hasTimedOut = None, False, False

    def update(self, values):
        self.get, self.exists = values, True

    def setTimeoutTimestamp(self, ms):
        pass

    def getCurrentWatermarkMs(self):
        return 0


def walked(batches):
    out, status, since, opened, seen = [], "offline", None, None, None
    for batch in batches:
        for at, key, s in sorted(batch, key=lambda e: e[:2]):
            if seen is not None and at < seen:
                continue
            if s != "idle" and opened is not None:
                out.append(("closed", seen, since, opened, at, round((at - since).total_seconds() / 60, 2), key - 1))
                opened = None
            since = None if s != "idle" else at if status != "idle" or since is None else since
            status, seen = s, at
            if s == "idle" and opened is None and at - since >= pd.Timedelta(minutes=45):
                opened = at
                out.append(("opened", at, since, at, None, round((at - since).total_seconds() / 60, 2), key))
        if seen is not None:
            out.append(("none", seen, since, opened, None, round((seen - since).total_seconds() / 60, 2) if since is not None else 0.0, None))
    return out


def test_the_fold_equals_a_walk_over_all_events():
    rnd = random.Random(5)
    kinds = set()
    for _ in range(60):
        n, state, got = rnd.randrange(1, 60), State(), []
        minute = sorted(rnd.uniform(0, 600) for _ in range(n))
        events = [(T0 + pd.Timedelta(seconds=round(m * 60)), i, rnd.choice(["idle", "idle", "idle", "idle", "on_trip"])) for i, m in enumerate(minute)]
        cut = rnd.randrange(n + 1)
        batches = [b for b in (events[:cut] + events[cut + 3 : cut + 5], events[cut:]) if b]
        for b in batches:
            rnd.shuffle(b)
            frame = pd.DataFrame([("e%05d" % k, at, s, "D1", "Z01", float(k), 2.0, 3.0, None) for at, k, s in b], columns=["event_id", "event_time", "status", "driver_id", "zone_id", "lat", "lon", "speed", "trip_id"])
            got += list(pd.concat(jobs.fold_vehicle(("V1",), iter([frame]), state)).itertuples(index=False))
        none = lambda x: None if pd.isna(x) else x
        rows = [(r.change, r.event_time, none(r.idle_since), none(r.opened_at), none(r.closed_at), r.idle_min) for r in got]
        assert rows == [w[:6] for w in walked(batches)]
        kinds |= {r[0] for r in rows}
    assert kinds == {"opened", "closed", "none"}


def test_few_events_are_looked_at_as_a_whole(monkeypatch):
    frame = pd.DataFrame({"event_id": [f"e{i:05d}" for i in range(5000)], "event_time": [T0 + pd.Timedelta(seconds=i) for i in range(5000)], "status": ["idle", "on_trip"] * 2500, "driver_id": "D1", "zone_id": "Z01", "lat": 1.0, "lon": 2.0, "speed": 3.0, "trip_id": None})
    walk, seen = pd.DataFrame.itertuples, []
    monkeypatch.setattr(pd.DataFrame, "itertuples", lambda self, **k: seen.append(len(self)) or walk(self, **k))
    assert [r.change for r in walk(pd.concat(jobs.fold_vehicle(("V1",), iter([frame]), State())))] == ["none"]
    assert sum(seen) == 1
