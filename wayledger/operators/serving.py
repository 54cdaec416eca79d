"""Live views, rankings, scheduling and quality summaries over the curated tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..params import DEFAULT, Params


def data_now(events: DataFrame) -> DataFrame:
    """One row: the newest event time."""
    return events.agg(F.max("event_time").alias("now"))


def _ago(minutes: int) -> Column:
    return F.expr(f"timestampadd(MINUTE, -{minutes}, now)")


def active(state: DataFrame, now: DataFrame, minutes: int, p: Params = DEFAULT) -> DataFrame:
    """Vehicles seen within ``minutes`` of data-now; the one-row side is broadcast."""
    s = state.join(F.broadcast(now)).where(F.col("event_time") >= _ago(minutes))
    return s.withColumn("offline", F.col("event_time") < _ago(p.offline_min))


def fleet_live(state: DataFrame, now: DataFrame, alerts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The active fleet as of the newest event, and the open alerts of active vehicles."""
    opened = alerts.where("alert AND status = 'open'").select("vehicle_id", F.lit(True).alias("alert_open")).distinct()
    a = active(state, now, p.live_min, p).where("NOT offline").join(opened, "vehicle_id", "left")
    per = a.agg(F.count("*").alias("active"), *[F.count_if(F.col("status") == s).alias(s) for s in ("idle", "on_trip", "enroute")], F.count_if(F.coalesce("alert_open", F.lit(False))).alias("open_alerts"))
    return per.withColumn("idle_ratio", F.round(X.safe_div(F.col("idle"), F.col("active")), 4)).join(F.broadcast(now.select(F.col("now").alias("as_of"))))


def zone_live(state: DataFrame, now: DataFrame, hourly: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Active vehicles by zone with the zone's current hour."""
    a = active(state, now, p.live_min, p).where("NOT offline AND zone_id IS NOT NULL")
    per = a.groupBy("zone_id").agg(F.max("now").alias("as_of"), F.count("*").alias("active"), F.count_if(F.col("status") == "idle").alias("idle"), F.count_if(F.col("status") == "on_trip").alias("on_trip"))
    hour = hour_of(hourly, now, 0).select("zone_id", "trips_started", "trips_completed", "earnings")
    return per.withColumn("idle_ratio", F.round(X.safe_div(F.col("idle"), F.col("active")), 4)).join(hour, "zone_id", "left").fillna(0).orderBy("zone_id")


def vehicle_map(state: DataFrame, now: DataFrame, p: Params = DEFAULT) -> DataFrame:
    a = active(state, now, p.map_min, p)
    return a.select("vehicle_id", F.when(F.col("offline"), "offline").otherwise(F.col("status")).alias("status"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "zone_id")


def hour_of(hourly: DataFrame, now: DataFrame, hours: int) -> DataFrame:
    """The zones' hour that lies ``hours`` before the current one."""
    start = F.expr(f"timestampadd(HOUR, -{hours}, cast(date_trunc('HOUR', now) AS timestamp_ntz))")
    return hourly.join(F.broadcast(now)).where(F.col("window_start") == start)


def hour_back(hourly: DataFrame, now: DataFrame, hours: int) -> DataFrame:
    """Trips and earnings of that hour."""
    return hour_of(hourly, now, hours).agg(F.coalesce(F.sum("trips_completed"), F.lit(0)).alias("trips"), F.round(F.coalesce(F.sum("earnings"), F.lit(0.0)), 2).alias("earnings"))


def zone_earnings(hourly: DataFrame, now: DataFrame) -> DataFrame:
    """Earnings and trips of the zones in the current hour, highest first."""
    return hour_of(hourly, now, 0).select("zone_id", "earnings", F.col("trips_completed").alias("trips")).orderBy(F.desc("earnings"), "zone_id")


def idle_alerts(islands: DataFrame, status: str | None = None, p: Params = DEFAULT) -> DataFrame:
    """Idle alerts, all or of one status, newest first; as many as the list shows."""
    found = islands.where("alert").select("vehicle_id", "opened_at", "closed_at", "idle_min", "status")
    if status in ("open", "closed"):
        found = found.where(F.col("status") == status)
    return found.orderBy(F.desc("opened_at"), "vehicle_id").limit(p.alerts_shown)


def zone_profile(hourly: DataFrame) -> DataFrame:
    """Each zone's hours on its own latest date, with the on-trip share of pings."""
    latest = hourly.groupBy("zone_id").agg(F.max("sim_day").alias("sim_day"))
    share = F.round(X.safe_div(F.col("on_trip_pings"), F.col("pings")), 4)
    return hourly.join(latest, ["zone_id", "sim_day"]).select("zone_id", "sim_day", F.col("sim_hour").cast("int").alias("sim_hour"), "trips_started", "trips_completed", "earnings", share.alias("on_trip_share"))


def fleet_summary(rec: DataFrame) -> DataFrame:
    """Day totals; margin and utilization come from the totals."""
    per = rec.groupBy("sim_date").agg(
        F.count("*").alias("vehicles"), F.sum("trips").alias("trips"), F.sum("revenue").alias("r"), F.sum("total_cost").alias("c"), F.sum("gps_km").alias("km"),
        F.sum("online_min").alias("online"), F.sum("on_trip_min").alias("on_trip"),
    )
    net = F.col("r") - F.col("c")
    return per.select("sim_date", "vehicles", "trips", F.round("r", 2).alias("revenue"), F.round("c", 2).alias("total_cost"), F.round(net, 2).alias("net_profit"), F.round(X.safe_div(net, F.col("r")), 4).alias("margin"), F.round("km", 2).alias("gps_km"), X.utilization(F.col("on_trip"), F.col("online")).alias("utilization"))


FLAGS = ("unprofitable", "becoming_unprofitable", "low_margin", "distance_mismatch", "in_service", "missing_costs", "missing_telemetry")


def flag_counts(rec: DataFrame) -> DataFrame:
    return rec.groupBy("sim_date").agg(*[F.count_if(F.col(f)).alias(f) for f in FLAGS])


def zone_dimension(spark: SparkSession, p: Params = DEFAULT) -> DataFrame:
    """Every zone with its centre."""
    zones = spark.range(p.rows * p.cols).select(F.concat(F.lit("Z"), F.lpad((F.col("id") + 1).cast("string"), 2, "0")).alias("zone_id"))
    lat, lon = X.zone_centre(F.col("zone_id"), p)
    return zones.select("zone_id", F.round(lat, 4).alias("lat"), F.round(lon, 4).alias("lon"))


def best_worst(rec: DataFrame, n: int = 5) -> DataFrame:
    top = Window.partitionBy("sim_date").orderBy(F.desc("net_profit"), "vehicle_id")
    low = Window.partitionBy("sim_date").orderBy("net_profit", "vehicle_id")
    r = rec.select("sim_date", "vehicle_id", "net_profit", F.row_number().over(top).alias("best"), F.row_number().over(low).alias("worst"))
    return r.where((F.col("best") <= n) | (F.col("worst") <= n))


def needs_attention(rec: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Rows with any flag but in_service, with their reasons and label, worst first by date."""
    any_flag = F.lit(False)
    for f in FLAGS:
        if f != "in_service":
            any_flag = any_flag | F.col(f)
    return rec.where(any_flag).withColumn("reasons", X.reasons(p)).withColumn("label", X.flag_label()).orderBy("sim_date", "net_profit", "vehicle_id")


def mismatches(rec: DataFrame) -> DataFrame:
    """Rows whose distances differ too much, widest first by date."""
    return rec.where("distance_mismatch").orderBy("sim_date", F.desc("mismatch_pct"), "vehicle_id")


def latest_markers(rec: DataFrame, drift: DataFrame, runs: DataFrame, now: DataFrame) -> DataFrame:
    """One row: newest event and reconciled date, the newest drift, the last run and the last
    successful one (the latter by its end)."""
    last = runs.agg(F.max_by(F.struct("run_id", "status"), F.struct("started_at", "run_id")).alias("l"))
    good = runs.where("status = 'success' AND finished_at IS NOT NULL").agg(F.max_by("run_id", F.struct("finished_at", "run_id")).alias("last_success"))
    gap = drift.agg(F.max_by(F.struct("sim_date", "drift_abs", "drift_ratio"), "sim_date").alias("d"))
    out = rec.agg(F.max("sim_date").alias("latest_date"))
    for one in (now, gap, last, good):  # all of them one row
        out = out.join(F.broadcast(one))
    return out.select("latest_date", "now", F.col("d.sim_date").alias("drift_date"), F.col("d.drift_abs").alias("drift_abs"), F.col("d.drift_ratio").alias("drift_ratio"), F.col("l.run_id").alias("last_run"), F.col("l.status").alias("last_status"), "last_success")


def history(rec: DataFrame, n: int = 7) -> DataFrame:
    """The newest ``n`` reconciled days of each vehicle."""
    w = Window.partitionBy("vehicle_id").orderBy(F.desc("sim_date"))
    return rec.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


DAY = ("trips", "revenue", "gps_km", "distance_covered", "fuel_cost", "maintenance_cost", "total_cost", "net_profit", "margin", "revenue_per_km", "cost_per_km", "utilization", *FLAGS)


def vehicle_merge(state: DataFrame, daily: DataFrame, rec: DataFrame, now: DataFrame, n: int = 7, p: Params = DEFAULT) -> DataFrame:
    """Live, today and history of every vehicle side by side, never added together.

    ``live`` and ``today`` are structs of the speed layer and ``history`` an array of structs of
    the batch layer, newest day first; each block names its source, and live and history the
    time they hold for. A block that a vehicle lacks is null.
    """
    live = state.select("vehicle_id", F.struct(F.lit("speed").alias("source"), F.col("event_time").alias("as_of"), "status", "zone_id", "lat", "lon", "speed", "trip_id").alias("live"))
    today = daily.join(F.broadcast(now)).where(F.col("sim_day") == F.to_date("now")).select("vehicle_id", F.struct(F.lit("speed").alias("source"), F.date_format("sim_day", "yyyy-MM-dd").alias("sim_date"), "trips", "revenue").alias("today"))
    block = F.struct("sim_date", F.lit("batch").alias("source"), F.timestamp_add("DAY", F.lit(1), F.col("sim_date").cast("timestamp_ntz")).alias("as_of"), *DAY, X.reasons(p).alias("reasons"))
    past = history(rec, n).groupBy("vehicle_id").agg(F.sort_array(F.collect_list(block), asc=False).alias("history"))
    return live.join(today, "vehicle_id", "full").join(past, "vehicle_id", "full")


def known_vehicles(state: DataFrame, rec: DataFrame) -> DataFrame:
    """Vehicles that the live state or the reconciled table knows."""
    return state.select("vehicle_id").unionByName(rec.select("vehicle_id")).distinct()


def drift(events: DataFrame, late: DataFrame) -> DataFrame:
    """Revenue and trips per date of the stream, which loses events that came late, and of the
    batch. The ratio keeps its sign: below zero the stream has counted something twice. Of
    an event that came twice the copy that was kept decides."""
    end = F.col("event_type") == "trip_end"
    per = lambda df, side: df.groupBy("sim_date").agg(F.round(F.sum(F.when(end, F.col("fare")).otherwise(0.0)), 2).alias(f"{side}_revenue"), F.count_if(end).alias(f"{side}_trips"))
    speed = events.join(late.select("event_id", "kafka_offset"), ["event_id", "kafka_offset"], "left_anti")
    j = per(speed, "speed").join(per(events, "batch"), "sim_date", "full").fillna(0)
    j = j.withColumn("drift_abs", F.round(F.col("batch_revenue") - F.col("speed_revenue"), 2))
    return j.withColumn("drift_ratio", F.round(X.safe_div(F.col("drift_abs"), F.col("batch_revenue")), 6))


def pending_dates(available: DataFrame, processed: DataFrame, now: Column, p: Params = DEFAULT) -> DataFrame:
    """Closed dates whose newest file version is newer than the one processed, oldest first."""
    j = available.join(processed, "sim_date", "left")
    return j.where(X.day_closed(F.col("sim_date"), now, p) & (F.col("version") > F.coalesce("processed_version", F.lit(0)))).select("sim_date", "version")


def overdue_dates(first: str, available: DataFrame, processed: DataFrame, now: str, p: Params = DEFAULT) -> DataFrame:
    """Dates past their deadline (``now`` as text) that have neither a file nor a run."""
    days = available.sparkSession.range(1).select(F.explode(F.expr(f"sequence(date'{first}', cast(timestamp_ntz'{now}' AS date))")).alias("d"))
    due = days.where(F.expr(f"timestamp_ntz'{now}' >= timestampadd(MINUTE, {24 * 60 + p.expense_sla_min}, cast(d AS timestamp_ntz))"))
    return due.select(F.date_format("d", "yyyy-MM-dd").alias("sim_date")).join(available, "sim_date", "left_anti").join(processed, "sim_date", "left_anti")


def dlq_rate(judged: DataFrame, minutes: int = 60) -> DataFrame:
    """Share of rejected events per arrival window."""
    per = judged.groupBy(F.window("arrival_time", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("events"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    return per.select(F.col("w.start").alias("window_start"), "events", "rejected", F.round(F.col("rejected") / F.col("events"), 6).alias("rate"))


def restatement(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys whose values differ between two versions of a table, or that only one has."""
    a = old.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values])
    b = new.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values])
    changed = F.lit(False)
    for v in values:
        changed = changed | ~F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}"))
    return a.join(b, keys, "full").where(changed)


def report_bundle(rec: DataFrame, runs: DataFrame, drift: DataFrame, issues: DataFrame, n: int = 5, p: Params = DEFAULT) -> DataFrame:
    """Everything that the day's report shows, of all dates in ``rec``, in long form: (sim_date,
    section, place, vehicle_id, label, value, note).

    Sections: ``summary`` (a row a figure), ``run`` and ``drift`` likewise, ``quarantine`` (rows by
    reason, most first), ``flagged`` (worst first, with label and reasons), ``best``, ``worst`` (``n``
    each) and ``mismatch`` (widest first). ``issues`` are the quarantined rows of the runs that
    count; of a date's runs the newest does. A date without runs, drift or issues has no such
    rows; null figures stay null. Lists stay rows, so no date has to fit in one value.
    """
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, section: str, place: Column, vehicle: Column, label: Column, value: Column, note: Column = none) -> DataFrame:
        return df.select("sim_date", F.lit(section).alias("section"), place.cast("int").alias("place"), text(vehicle).alias("vehicle_id"), text(label).alias("label"), value.cast("double").alias("value"), text(note).alias("note"))

    def figures(df: DataFrame, section: str, names: list[str], note: Column = none) -> DataFrame:
        each = F.posexplode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("value")) for c in names])).alias("i", "x")
        return rows(df.select("sim_date", note.alias("said"), each), section, F.col("i") + 1, none, F.col("x.label"), F.col("x.value"), F.col("said"))

    nth = lambda *order: F.row_number().over(Window.partitionBy("sim_date").orderBy(*order, "vehicle_id"))
    newest = runs.groupBy("sim_date").agg(F.max_by(F.struct("run_id", "version", "quarantined", F.col("late").cast("int").alias("late")), F.struct("started_at", "run_id")).alias("r")).select("sim_date", "r.*")
    dates = rec.select("sim_date").distinct()
    why = issues.groupBy("sim_date", "reason").agg(F.count("*").alias("c"))
    ranked = F.row_number().over(Window.partitionBy("sim_date").orderBy(F.desc("c"), "reason"))
    top = best_worst(rec, n)
    wide = mismatches(rec).withColumn("nth", nth(F.desc("mismatch_pct")))
    flagged = needs_attention(rec, p).withColumn("nth", nth("net_profit"))
    parts = [
        figures(fleet_summary(rec), "summary", ["vehicles", "trips", "revenue", "total_cost", "net_profit", "margin", "gps_km", "utilization"]),
        figures(newest.join(dates, "sim_date", "left_semi"), "run", ["version", "late", "quarantined"], F.col("run_id")),
        figures(drift.join(dates, "sim_date", "left_semi"), "drift", ["speed_revenue", "batch_revenue", "drift_ratio"]),
        rows(why.join(dates, "sim_date", "left_semi").withColumn("nth", ranked), "quarantine", F.col("nth"), none, F.col("reason"), F.col("c")),
        rows(flagged, "flagged", F.col("nth"), F.col("vehicle_id"), F.col("label"), F.col("net_profit"), F.array_join("reasons", "; ")),
        rows(top.where(F.col("best") <= n), "best", F.col("best"), F.col("vehicle_id"), none, F.col("net_profit")),
        rows(top.where(F.col("worst") <= n), "worst", F.col("worst"), F.col("vehicle_id"), none, F.col("net_profit")),
        rows(wide, "mismatch", F.col("nth"), F.col("vehicle_id"), none, F.col("mismatch_pct")),
    ]
    return reduce(DataFrame.unionByName, parts)
