"""The upsert store against a dictionary."""

import math
import random

import pytest

from wayledger.streaming.upserts import KEPT, UpsertStore, _columns

SCHEMA = "vehicle_id string, day int, x int, tags array<struct<a:int,b:string>>"


def frame(spark, rows):
    return spark.createDataFrame([(v, d, x, [(x, "t")]) for (v, d), x in rows.items()], SCHEMA)


def test_columns_of_nested_types():
    assert _columns("a int, b array<struct<x:int,y:string>>, c decimal(10,2)") == ["a int", "b array<struct<x:int,y:string>>", "c decimal(10,2)"]


def test_many_batches_lie_in_few_runs(spark, tmp_path):
    """Batches with new, changed and repeated keys, a null key, an empty batch and replays."""
    rng = random.Random(3)
    store = UpsertStore(spark, f"file://{tmp_path}/t", ["vehicle_id", "day"], SCHEMA)
    want, most = {}, 0
    assert store.read().collect() == []
    for batch in range(24):
        rows = {} if batch == 5 else {(rng.choice([None, *"abcdefgh"]), rng.randrange(40)): rng.randrange(1000) for _ in range(12)}
        want |= rows
        store.write(frame(spark, rows), batch)
        if batch % 7 == 3:
            store.write(frame(spark, {k: -1 for k in rows}), batch)
        most = max(most, len(store.manifest()["runs"]))
    got = {(r["vehicle_id"], r["day"]): r["x"] for r in store.read().collect()}
    assert got == want and store.read().count() == len(want)
    assert most <= math.log2(len(want)) + 2
    runs = store.manifest()["runs"]
    assert all(r["rows"] > sum(n["rows"] for n in runs[i + 1 :]) for i, r in enumerate(runs[:-1]))
    assert len(store.manifests.names(f"{store.root}/runs")) <= 3 * KEPT


def test_a_merge_that_dies_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    store = UpsertStore(spark, f"file://{tmp_path}/t", ["vehicle_id", "day"], SCHEMA)
    store.write(frame(spark, {("a", 1): 1}), 0)
    monkeypatch.setattr(store.manifests, "publish", lambda entry: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        store.write(frame(spark, {("a", 1): 2}), 1)
    assert [r["x"] for r in store.read().collect()] == [1]
    again = UpsertStore(spark, store.root, ["vehicle_id", "day"], SCHEMA)
    again.write(frame(spark, {("a", 1): 2}), 1)
    assert [r["x"] for r in store.read().collect()] == [2]


def test_two_writers_and_two_queries(spark, tmp_path, monkeypatch):
    store = UpsertStore(spark, f"file://{tmp_path}/t", ["vehicle_id", "day"], SCHEMA)
    store.write(frame(spark, {("a", 1): 1}), 0, "one")
    store.write(frame(spark, {("a", 1): 2}), 0, "two")
    store.write(frame(spark, {("a", 1): 3}), 0, "one")
    assert [r["x"] for r in store.read().collect()] == [2]
    old = store.manifest() | {"version": 0}
    monkeypatch.setattr(store, "manifest", lambda: old)
    with pytest.raises(RuntimeError, match="another writer"):
        store.write(frame(spark, {("b", 1): 1}), 9, "one")


def test_a_stream_writes_through_it(spark, tmp_path):
    for i in range(3):
        frame(spark, {("a", 1): i, (f"v{i}", 2): i}).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    store = UpsertStore(spark, f"file://{tmp_path}/t", ["vehicle_id", "day"], SCHEMA)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    for _ in range(2):
        stream.writeStream.option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).foreachBatch(store.write).start().awaitTermination()
    assert {(r["vehicle_id"], r["day"]) for r in store.read().collect()} == {("a", 1), ("v0", 2), ("v1", 2), ("v2", 2)}
    assert store.manifest()["batches"] == {"": 2}


def test_an_intake_that_fails_between_its_tables_leaves_no_double_rows(spark, tmp_path, monkeypatch):
    from wayledger.operators import telemetry as T
    from wayledger.streaming import jobs

    ok = '{"event_id":"%d","event_type":"ping","trip_id":null,"driver_id":"D","vehicle_id":"V1","lat":13.0,"lon":77.6,"speed":1.0,"status":"idle","fare":0.0,"timestamp":"2024-01-01T0%d:00:00Z","schema_version":1}'
    for i in range(3):
        spark.createDataFrame([("k", ok % (i, i)), ("k", "{broken")], "key string, value string").coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    stream = T.archived(spark.readStream.schema("key string, value string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*").selectExpr("*", "0 AS kafka_offset"))
    root, write, calls = f"file://{tmp_path}/out", jobs.own, []

    def failing(df, path, batch, *by):
        calls.append(path)
        if len(calls) == 5:
            raise OSError("gone")
        write(df, path, batch, *by)

    monkeypatch.setattr(jobs, "own", failing)
    run = lambda: stream.writeStream.option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).foreachBatch(jobs.intake(root)).start().awaitTermination()
    with pytest.raises(Exception, match="gone"):
        run()
    run()
    rows = lambda name: spark.read.parquet(f"{root}/{name}")
    assert (rows("archive").count(), rows("dlq").count(), rows("dlq_reasons").agg({"rows": "sum"}).first()[0]) == (6, 3, 3)
    assert {str(r[0]) for r in rows("archive").select("sim_date").distinct().collect()} == {"2024-01-01", "unknown"}
