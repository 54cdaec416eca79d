"""Source rows are derived on all cores, parsed once, and ids that vehicles share are found among few rows."""

from types import SimpleNamespace

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from wayledger.operators import telemetry as T
from wayledger.plans import queries
from wayledger.schemas import EVENT
from wayledger.sources import fleet
from wayledger.streaming import monitor

SF = "/root/testdata/sf0.001"


def test_a_filter_on_parsed_fields_does_not_parse_again(spark):
    wire = queries.Fleet(spark, SF).wire
    for df in (T.valid(T.archived(wire)), T.invalid(T.archived(wire)), T.parse(wire).where("lat > 0 AND lon > 0 AND status = 'idle'")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_every_text_gives_one_row(spark):
    texts = [None, "", "{", "null", "[]", '{"event_id": 5, "lat": "x", "lon": 1}', '[{"event_id": "a"}]']
    got = T.parse(spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "value string, i int"))
    was = got.select("i", "raw_value", F.from_json("raw_value", EVENT).alias("e")).select("i", "e.*")
    assert got.count() == len(texts) and got.select(was.columns).exceptAll(was).isEmpty()


def test_a_file_of_one_row_group_is_derived_on_all_cores(spark):
    assert pq.ParquetFile(f"{SF}/events.parquet").num_row_groups == 1
    f = queries.Fleet(spark, SF)
    parts = f.wire.where("kafka_offset < 1000000000").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == spark.sparkContext.defaultParallelism and max(r["count"] for r in parts) < 2 * sum(r["count"] for r in parts) / len(parts)
    plain = fleet.wire(f.events)
    assert f.wire.exceptAll(plain).isEmpty() and f.wire.count() == plain.count()


def test_suspects_hold_all_rows_of_shared_ids_and_few_others(spark):
    at = "timestamp_ntz'2024-03-01 10:00:00'"
    events = spark.range(1000).selectExpr("'2024-03-01' AS sim_date", "concat('e', id) AS event_id", "concat('V', id % 7) AS vehicle_id", f"{at} AS event_time", "id AS kafka_offset")
    twice = events.where("kafka_offset IN (3, 500)").withColumn("vehicle_id", F.lit("V9")).withColumn("kafka_offset", F.col("kafka_offset") + 1000)
    both = events.unionByName(twice)
    assert T.suspects(events).isEmpty() and T.suspects(both).count() == 2
    left = T.suspected(both, T.suspects(both))
    assert {r["event_id"] for r in left.collect()} == {"e3", "e500"} and left.count() == 4 and left.columns == both.columns
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(T.shared(left)) == rows(T.shared(both)) == [("2024-03-01", "e3", "V9"), ("2024-03-01", "e500", "V9")]


def test_a_trigger_of_all_jobs_does_not_grow_with_the_log():
    log = lambda longest: SimpleNamespace(newest=lambda: {"ends": {"0": longest, "1": 5}})
    assert [monitor.share_offsets(log(n), 4) for n in (0, 9, 1_000_000, 6_000_000, 10**9)] == [2, 3, 250_000, 320_000, 320_000]
