"""Validation of expense files and reconciliation with telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..params import DEFAULT, Params
from ..schemas import EXPENSE_COLUMNS

NUMBERS = ("fuel_cost", "maintenance_cost", "distance_covered")


def judged(lines: DataFrame, roster: DataFrame) -> DataFrame:
    """``reason`` of every line: duplicate, missing_value, negative_value, unknown_vehicle.

    A line is a duplicate if its trimmed id stood earlier in the file, valid or not; the
    roster is compared with the id as written.
    """
    trimmed = F.trim("vehicle_id")
    first = Window.partitionBy("sim_date", "version", trimmed).orderBy("line_no")
    known = roster.select(F.col("vehicle_id").alias("known_id")).distinct()
    e = lines.withColumn("nth", F.row_number().over(first)).join(known, F.col("vehicle_id") == F.col("known_id"), "left")
    e = e.withColumns({f"{c}_n": F.expr(f"try_cast(trim({c}) AS double)") for c in NUMBERS})
    blank = F.lit(False)
    for c in EXPENSE_COLUMNS:
        blank = blank | (F.coalesce(F.trim(c), F.lit("")) == "")
    bad, negative = blank, F.lit(False)
    for c in NUMBERS:
        bad, negative = bad | F.col(f"{c}_n").isNull(), negative | (F.col(f"{c}_n") < 0)
    duplicate = (F.col("nth") > 1) & (F.coalesce(trimmed, F.lit("")) != "")
    return e.withColumn("reason", X.first_failing([("duplicate", duplicate), ("missing_value", bad), ("negative_value", negative), ("unknown_vehicle", F.col("known_id").isNull())])).drop("nth", "known_id")


def clean(lines: DataFrame, roster: DataFrame) -> DataFrame:
    ok = judged(lines, roster).where("reason IS NULL")
    flag = F.lower(F.trim("service_flag")).isin("true", "1", "yes")
    return ok.select("sim_date", "version", F.trim("vehicle_id").alias("vehicle_id"), *[F.col(f"{c}_n").alias(c) for c in NUMBERS], flag.alias("service_flag"))


def gate(lines: DataFrame, roster: DataFrame, p: Params = DEFAULT, files: DataFrame | None = None) -> DataFrame:
    """Per file: rows, invalid rows, their ratio, and whether the file is accepted.

    ``files`` (sim_date, version) lists the files that came in: one of them without any line
    is refused, with a null ratio.
    """
    per = judged(lines, roster).groupBy("sim_date", "version").agg(F.count("*").alias("total"), F.count_if(F.col("reason").isNotNull()).alias("invalid"))
    if files is not None:
        per = files.select("sim_date", "version").distinct().join(per, ["sim_date", "version"], "left").fillna(0, ["total", "invalid"])
    ratio = F.try_divide(F.col("invalid"), F.col("total"))
    return per.withColumn("invalid_ratio", F.round(ratio, 6)).withColumn("accepted", F.coalesce(ratio <= p.invalid_ratio, F.lit(False)))


def strict(gated: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The same rows; a refused file fails the job that reads them."""
    why = F.when(F.col("total") == 0, F.lit("the expense file has no rows")).otherwise(F.concat(F.round(F.col("invalid_ratio") * 100, 1).cast("string"), F.lit(f"% of the expense rows are invalid, more than {p.invalid_ratio:.0%}")))
    return gated.withColumn("accepted", F.when(F.col("accepted"), F.lit(True)).otherwise(F.raise_error(F.concat("sim_date", F.lit(": "), why)).cast("boolean")))


def refusal(total: int, ratio: float | None, p: Params = DEFAULT) -> str:
    """Why a file is refused, for the run log."""
    return "the expense file has no rows" if not total else f"{ratio:.1%} of the expense rows are invalid, more than {p.invalid_ratio:.0%}"


def quarantined(lines: DataFrame, roster: DataFrame, run_id: Column) -> DataFrame:
    """The invalid lines of a run with the reason and the line as JSON."""
    bad = judged(lines, roster).where("reason IS NOT NULL")
    return bad.select(run_id.alias("run_id"), "sim_date", F.lit("expenses").alias("source"), "vehicle_id", "reason", F.to_json(F.struct(*EXPENSE_COLUMNS)).alias("payload"))


def reconciled(days: DataFrame, costs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Full outer join of vehicle-days and expenses with profit, ratios and flags.

    Both per-km figures are per GPS kilometre; the mismatch is relative to the distance that
    was reported, so a vehicle that was billed without telemetry differs by all of it. Every
    figure is computed from the rounded ones before it.
    """
    left = days.select("sim_date", "vehicle_id", "trips", "revenue", "gps_km", "online_min", "on_trip_min", "idle_min", "utilization", F.lit(True).alias("has_telemetry"))
    right = costs.select("sim_date", "vehicle_id", *NUMBERS, "service_flag", F.lit(True).alias("has_costs"))
    j = left.join(right, ["sim_date", "vehicle_id"], "full").fillna(0).fillna(False)
    reported = F.col("distance_covered")
    j = j.withColumn("total_cost", F.round(F.col("fuel_cost") + F.col("maintenance_cost"), 2))
    j = j.withColumn("net_profit", F.round(F.col("revenue") - F.col("total_cost"), 2))
    j = j.withColumns({
        "margin": X.round_ratio(X.safe_div(F.col("net_profit"), F.col("revenue"))),
        "revenue_per_km": X.round_ratio(X.safe_div(F.col("revenue"), F.col("gps_km"))), "cost_per_km": X.round_ratio(X.safe_div(F.col("total_cost"), F.col("gps_km"))),
        "mismatch_pct": X.round_ratio(F.when(reported > 0, F.abs(F.col("gps_km") - reported) / reported).otherwise(0.0)),
    })
    j = j.withColumns({
        "unprofitable": F.col("net_profit") < 0, "low_margin": (F.col("revenue") > 0) & (F.col("margin") < p.low_margin), "distance_mismatch": F.col("mismatch_pct") > p.distance_mismatch,
        "in_service": F.col("service_flag"), "missing_costs": ~F.col("has_costs"), "missing_telemetry": ~F.col("has_telemetry"),
    })
    return j.drop("has_telemetry", "has_costs", "service_flag")


def with_provenance(rec: DataFrame, runs: DataFrame) -> DataFrame:
    """``rec`` with the expense file version and the run that made each date, from (sim_date,
    version, run_id); dates without an expense file have neither."""
    made = runs.select("sim_date", F.col("version").alias("expense_file_version"), "run_id")
    return rec.join(made, "sim_date", "left")


def with_trend(rows: DataFrame) -> DataFrame:
    """``becoming_unprofitable`` over a vehicle's last three rows: falling twice, or two losses."""
    w = Window.partitionBy("vehicle_id").orderBy("sim_date")
    a, b, c = F.lag("net_profit", 2).over(w), F.lag("net_profit", 1).over(w), F.col("net_profit")
    losses = sum(((x < 0).cast("int") for x in (b, c)), (a < 0).cast("int"))
    return rows.withColumn("becoming_unprofitable", F.coalesce(((a > b) & (b > c)) | (losses >= 2), F.lit(False)))
