"""A bounded stream whose triggers hold many steps drops what one with small triggers drops."""

from types import SimpleNamespace

from wayledger.operators import telemetry as T
from wayledger.plans import queries
from wayledger.streaming import monitor

SF = "/root/testdata/sf0.001"


def test_triggers_are_whole_steps_and_few():
    log = lambda longest: SimpleNamespace(newest=lambda: {"ends": {"0": longest, "1": 5}})
    assert [monitor.trigger_offsets(log(n), 400) for n in (0, 1_000, 6_401, 101_000, 10**9)] == [400, 400, 800, 6_400, 320_000]


def test_steps_in_large_triggers_drop_what_small_triggers_drop(spark, monkeypatch):
    monkeypatch.setattr(monitor, "TRIGGERS", 3)
    kept, seen, progress, log = monitor.run_stepped(queries.Fleet(spark, SF).wire, 20)
    place = lambda df: {(r["log_partition"], r["log_offset"]) for r in df.collect()}
    whole = T.archived(log.read())
    late = place(T.late_in_triggers(whole, 20))
    assert late and place(kept) == place(T.valid(whole)) - late and kept.count() == len(place(kept))
    assert progress.where("input_rows > 0").count() <= 3 < seen.select("batch").distinct().count()
    ends = log.newest()["ends"]
    got = {(r["batch_id"], r["partition"]): (r["reached"], r["behind"]) for r in monitor.steps_behind(seen, log).collect()}
    steps = range(-(-max(ends.values()) // 20))
    assert got == {(b, int(p)): (min(end, 20 * b + 20), end - min(end, 20 * b + 20)) for b in steps for p, end in ends.items()}
