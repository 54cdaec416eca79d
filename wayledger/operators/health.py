"""Run log, alert notifications, pipeline status, batch metrics and health rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALERTS = "struct<alerts: array<struct<status: string, labels: map<string,string>, annotations: map<string,string>, startsAt: string, endsAt: string>>>"
FINISHED = ("success", "failed")

# Rule, metric, sign of the comparison, threshold, severity.
RULES = [
    ("TelemetryNotProduced", "telemetry_events", "<", 1.0, "critical"),
    ("DLQRateHigh", "dlq_rate", ">", 0.02, "warning"),
    ("StreamStalled", "stream_stalled", ">", 0.0, "critical"),
    ("StreamLagHigh", "offsets_behind", ">", 5000.0, "warning"),
    ("ExpenseFileLate", "expense_file_late", ">", 0.0, "warning"),
    ("BatchRunFailed", "batch_run_failed", ">", 0.0, "critical"),
    ("BatchNotRunRecently", "seconds_since_success", ">", 2700.0, "warning"),
    ("SpeedBatchDriftHigh", "speed_batch_drift", "abs >", 0.05, "warning"),
    ("IdleVehiclesHigh", "open_idle_alerts", ">", 8.0, "warning"),
]


RUN_ENTRY = "run_id string, sim_date string, version int, at timestamp_ntz, status string, late boolean, quarantined long, notes string, durations map<string,double>"


def append_runs(entries: DataFrame, root: str) -> None:
    """Add entries to the run log: an append, so nothing that was logged is rewritten."""
    names = [c.split(" ")[0] for c in RUN_ENTRY.split(", ")]
    kinds = dict(c.split(" ") for c in RUN_ENTRY.split(", "))
    entries.select(*[(F.col(c) if c in entries.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names]).coalesce(1).write.mode("append").parquet(root)


def run_started(spark: SparkSession, run_id: str, sim_date: str, version: int, at: Column, late: bool = False) -> DataFrame:
    """The log entry of a run that begins."""
    return spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(sim_date).alias("sim_date"), F.lit(version).alias("version"), at.alias("at"), F.lit("running").alias("status"), F.lit(late).alias("late"))


def run_finished(spark: SparkSession, run_id: str, status: str, at: Column, quarantined: int | None = None, notes: str | None = None, durations: dict[str, float] | None = None) -> DataFrame:
    """The log entry of a run's end, "success" or "failed"."""
    tasks = F.create_map(*[F.lit(x) for kv in (durations or {}).items() for x in kv]) if durations else F.lit(None)
    return spark.range(1).select(F.lit(run_id).alias("run_id"), at.alias("at"), F.lit(status).alias("status"), F.lit(quarantined).alias("quarantined"), F.lit(notes).alias("notes"), tasks.alias("durations"))


def task_took(spark: SparkSession, run_id: str, task: str, seconds: float, at: Column) -> DataFrame:
    """The log entry of one task's time, merged with the others of the run when read."""
    return spark.range(1).select(F.lit(run_id).alias("run_id"), at.alias("at"), F.create_map(F.lit(task), F.lit(round(seconds, 3))).alias("durations"))


def run_log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(RUN_ENTRY).parquet(root)


def processed_versions(runs: DataFrame) -> DataFrame:
    """The highest expense file version of each date that a run finished well with."""
    return runs.where("status = 'success'").groupBy("sim_date").agg(F.max("version").alias("processed_version"))


def run_log_latest(events: DataFrame) -> DataFrame:
    """One row per run of a log of (run_id, sim_date, at, status, late, quarantined, durations).

    The newest value that is not null wins; task durations of all entries are merged, the
    newest of a task wins. Entries grow by a few per run, tasks are those of one run.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    done = F.max(F.when(F.col("status").isin(*FINISHED), F.col("at"))).alias("finished_at")
    known = [last(c) for c in ("sim_date", "version", "status", "late", "quarantined") if c in events.columns]
    runs = events.groupBy("run_id").agg(*known, F.min("at").alias("started_at"), done)
    tasks = events.select("run_id", "at", F.explode("durations").alias("task", "seconds")).groupBy("run_id", "task").agg(F.max_by("seconds", "at").alias("seconds"))
    merged = tasks.groupBy("run_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("task", "seconds")))).alias("durations"))
    return runs.join(merged, "run_id", "left")


def _kept_time(c: str) -> Column:
    """A time whose year starts with 2; the zero time and broken text are null."""
    return F.when(F.col(c).startswith("2"), F.expr(f"try_to_timestamp({c})").cast("timestamp_ntz"))


def alert_rows(payloads: DataFrame, value: str = "payload") -> DataFrame:
    """One row per alert of each webhook payload; a payload that isn't JSON has none."""
    one = payloads.select(F.explode(F.from_json(value, ALERTS)["alerts"]).alias("a")).select("a.*")
    return one.select(
        F.coalesce(F.col("labels")["alertname"], F.lit("unknown")).alias("alertname"), F.col("labels")["severity"].alias("severity"), "status",
        F.col("annotations")["summary"].alias("summary"), _kept_time("startsAt").alias("starts_at"), _kept_time("endsAt").alias("ends_at"), "labels",
    )


def recent_alerts(alerts: DataFrame, n: int = 25) -> DataFrame:
    """The newest ``n`` notifications."""
    return alerts.orderBy(F.desc("starts_at"), "alertname", "summary").limit(n)


def newest_run(runs: DataFrame) -> DataFrame:
    """The last run of any status: one row."""
    return runs.agg(F.max_by(F.struct(*runs.columns), F.struct("started_at", "run_id")).alias("r")).select("r.*")


def pipeline_status(now: DataFrame, clock: Column, runs: DataFrame, drift: DataFrame, open_alerts: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: how far telemetry, runs, drift, alerts and data quality are."""
    lag = F.round(F.expr("timestampdiff(SECOND, latest_event, clock)") / 60, 2)
    head = now.select(F.col("now").alias("latest_event"), clock.alias("clock")).select("latest_event", lag.alias("lag_min"))
    last = newest_run(runs).select(F.col("run_id").alias("last_run"), F.col("status").alias("last_status"))
    good = runs.agg(F.max(F.when(F.col("status") == "success", F.col("sim_date"))).alias("last_good_date"))
    gap = drift.agg(F.max_by("drift_ratio", "sim_date").alias("drift_ratio"))
    bad = issues.agg(F.count("*").alias("dq_issues"))
    out = head
    for one in (last, good, gap, open_alerts, bad):  # all of them one row
        out = out.join(F.broadcast(one))
    return out


def stalled(launched: DataFrame, progress: DataFrame, now: DataFrame, silent_s: int = 120, grace_s: int = 120) -> DataFrame:
    """Queries of (query, started_at, active) that need a restart, with the reason.

    ``progress`` is (query, at). An inactive query is reported at once, one without progress or
    silent for longer than ``silent_s`` only after ``grace_s`` from its start.
    """
    j = launched.join(progress.groupBy("query").agg(F.max("at").alias("last_at")), "query", "left").join(F.broadcast(now))
    after = lambda c: F.expr(f"timestampdiff(SECOND, {c}, now)")
    late = after("started_at") >= grace_s
    reason = F.when(~F.col("active"), "inactive").when(late & F.col("last_at").isNull(), "no_progress").when(late & (after("last_at") > silent_s), "silent")
    return j.select("query", "last_at", reason.alias("reason")).where("reason IS NOT NULL")


def _metric(df: DataFrame, name: str, value: Column, label: Column | None = None) -> DataFrame:
    return df.select(F.lit(name).alias("metric"), (F.lit("") if label is None else label).alias("label"), value.cast("double").alias("value"))


def batch_metrics(runs: DataFrame, drift: DataFrame, open_alerts: DataFrame) -> DataFrame:
    """(metric, label, value): the last good run, the late and failed flags of the last run of any
    status, the newest drift, and open alerts."""
    good = newest_run(runs.where("status = 'success'")).where("run_id IS NOT NULL")
    last = newest_run(runs)
    parts = [
        _metric(good, "batch_last_success", F.unix_timestamp("finished_at")), _metric(good, "batch_quarantined_rows", F.coalesce("quarantined", F.lit(0))),
        _metric(good.select(F.explode("durations").alias("task", "seconds")), "batch_task_duration", F.col("seconds"), F.col("task")),
        _metric(last, "expense_file_late", F.coalesce(F.col("late").cast("int"), F.lit(0))), _metric(last, "batch_run_failed", F.coalesce((F.col("status") == "failed").cast("int"), F.lit(0))),
        _metric(drift.agg(F.max_by("drift_ratio", "sim_date").alias("x")).where("x IS NOT NULL"), "speed_batch_drift", F.col("x")), _metric(open_alerts, "open_idle_alerts", F.col("open_alerts")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def health_rules(metrics: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """(rule, severity, firing, value) of every rule; a metric with labels counts by its largest
    value, and a rule without its metric doesn't fire."""
    table = metrics.sparkSession.createDataFrame(rules, "rule string, metric string, sign string, threshold double, severity string")
    worst = metrics.groupBy("metric").agg(F.max("value").alias("value"))
    above = F.when(F.col("sign") == "abs >", F.abs("value")).otherwise(F.col("value")) > F.col("threshold")
    firing = F.when(F.col("sign") == "<", F.col("value") < F.col("threshold")).otherwise(above)
    return F.broadcast(table).join(worst, "metric", "left").select("rule", "severity", F.coalesce(firing, F.lit(False)).alias("firing"), F.round("value", 6).alias("value"))
