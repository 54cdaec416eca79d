"""The report in long form: sections, places, the newest run, dates without runs, empty tables."""

from pyspark.sql import functions as F

from wayledger.operators import serving as S

REC = "sim_date string, vehicle_id string, trips long, revenue double, total_cost double, net_profit double, margin double, gps_km double, online_min double, on_trip_min double, mismatch_pct double, " + ", ".join(f"{f} boolean" for f in S.FLAGS)


def _rec(spark, rows):
    off = {f: False for f in S.FLAGS}
    full = [{"sim_date": d, "vehicle_id": v, "trips": 1, "revenue": net + 10, "total_cost": 10.0, "net_profit": net, "margin": 0.5, "gps_km": 1.0, "online_min": 10.0, "on_trip_min": 5.0, "mismatch_pct": mis, **off, "unprofitable": net < 0, "distance_mismatch": mis > 0.15} for d, v, net, mis in rows]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in REC.split(", ")) for r in full], REC)


def test_sections_of_two_dates(spark):
    rec = _rec(spark, [("d1", f"V{i}", float(10 - i) if i != 7 else -3.0, 0.2 if i in (2, 4) else 0.0) for i in range(8)] + [("d2", "V0", 5.0, 0.0)])
    at = lambda s: F.expr(f"timestamp_ntz'2024-01-01 00:00:0{s}'")
    run = "run_id string, sim_date string, version int, late boolean, quarantined long, s int"
    runs = spark.createDataFrame([("r1", "d1", 1, True, 9, 1), ("r2", "d1", 2, False, None, 2), ("r9", "d9", 1, False, 0, 1)], run).withColumn("started_at", F.when(F.col("s") == 1, at(1)).otherwise(at(2)))
    drift = spark.createDataFrame([("d1", 90.0, 100.0, 0.1), ("d9", 1.0, 1.0, 0.0)], "sim_date string, speed_revenue double, batch_revenue double, drift_ratio double")
    issues = spark.createDataFrame([("d1", r) for r in ("b", "a", "b", "c", "a")] + [("d9", "a")], "sim_date string, reason string")
    got = [tuple(r) for r in S.report_bundle(rec, runs, drift, issues, 3).collect()]
    pick = lambda d, section: [r[2:] for r in sorted(x for x in got if x[:2] == (d, section))]
    assert {r[0] for r in got} == {"d1", "d2"}
    assert pick("d1", "quarantine") == [(1, None, "a", 2.0, None), (2, None, "b", 2.0, None), (3, None, "c", 1.0, None)]
    assert pick("d1", "run") == [(1, None, "version", 2.0, "r2"), (2, None, "late", 0.0, "r2"), (3, None, "quarantined", None, "r2")]
    assert [r[3] for r in pick("d1", "drift")] == [90.0, 100.0, 0.1] and not pick("d2", "drift") and not pick("d2", "run")
    # Equal figures go by vehicle.
    assert [r[1] for r in pick("d1", "best")] == ["V0", "V1", "V2"] and [r[1] for r in pick("d1", "worst")] == ["V7", "V6", "V5"]
    assert [r[1] for r in pick("d1", "mismatch")] == ["V2", "V4"] and [r[1] for r in pick("d1", "flagged")] == ["V7", "V4", "V2"]
    assert all(r[4] for r in pick("d1", "flagged")) and not pick("d2", "flagged")
    assert [r[3] for r in pick("d2", "summary")][:5] == [1.0, 1.0, 15.0, 10.0, 5.0]
    none = S.report_bundle(rec.where("false"), runs, drift, issues)
    assert none.isEmpty()
