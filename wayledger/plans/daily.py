"""The daily job: one date's expense file against that date's telemetry, as one call.

validate the file -> quarantine its bad lines -> refuse a file that is too bad -> figures of the
day from its archive partition -> reconcile -> trend -> replace -> report -> run log.

The curated table is kept in versions (``sources.snapshots``); beside it goes a summary of each
vehicle, its first and last date and its last two net figures, onto which a new day is folded.
What one date costs doesn't grow with history: files and archive are read for that date, and of
the table the dates before and after it until each vehicle's two rows on either side are found.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import expenses as E
from ..operators import health as H
from ..operators import serving as S
from ..operators import telemetry as T
from ..params import DEFAULT, Params
from ..sources import landing
from ..sources.snapshots import Snapshots
from ..streaming import jobs

CURATED = (
    "sim_date string, vehicle_id string, trips long, revenue double, gps_km double, online_min double, on_trip_min double, idle_min double, utilization double, "
    "fuel_cost double, maintenance_cost double, distance_covered double, total_cost double, net_profit double, margin double, revenue_per_km double, cost_per_km double, mismatch_pct double, "
    "unprofitable boolean, becoming_unprofitable boolean, low_margin boolean, distance_mismatch boolean, in_service boolean, missing_costs boolean, missing_telemetry boolean, "
    "expense_file_version int, run_id string"
)
COLUMNS = [c.split(" ")[0] for c in CURATED.split(", ")]
#: Per vehicle: its first and last date and the net figures of its last two rows.
SUMMARY = "vehicle_id string, first_date string, last_date string, last_net double, before_net double"


@dataclass(frozen=True)
class Stores:
    """Where the job reads and writes: folders that driver and executors share."""

    spark: SparkSession
    archive: str
    archive_schema: str
    landing: str
    table: Snapshots
    quarantine: str
    runs: str
    reports: str
    roster: DataFrame


def archive_day(stores: Stores, sim_date: str) -> DataFrame:
    """The date's partition; a date or an archive that isn't there has no rows."""
    try:
        archive = stores.spark.read.schema(stores.archive_schema).parquet(stores.archive)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        archive = stores.spark.createDataFrame([], stores.archive_schema)
    return T.of_date(archive, sim_date)


def run_log(stores: Stores) -> DataFrame:
    """Entries of the log so far; none before the first run."""
    try:
        return H.run_log(stores.spark, stores.runs)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return stores.spark.createDataFrame([], H.RUN_ENTRY)


def nearest_rows(table: Snapshots, version: int, sim_date: str, wanted: DataFrame, later: bool, n: int = 2) -> DataFrame:
    """Of each vehicle in ``wanted`` (vehicle_id, bound) the ``n`` nearest stored rows before or
    after a date. ``bound`` is the vehicle's first or last date: beyond it there is none.

    Dates are read outwards, two, then four, then eight more, until every vehicle has its rows
    or its bound is passed. Vehicles that run daily need two dates.
    """
    held = sorted((d for d in table.manifest(version)["dates"] if (d > sim_date if later else d < sim_date)), reverse=not later)
    order = Window.partitionBy("vehicle_id").orderBy("sim_date" if later else F.desc("sim_date"))
    chosen, step, out = [], n, table.read(version, []).join(wanted.select("vehicle_id"), "vehicle_id", "left_semi")
    while len(chosen) < len(held):
        chosen, step = held[: len(chosen) + step], 2 * step
        rows = table.read(version, chosen).join(wanted.select("vehicle_id"), "vehicle_id", "left_semi")
        out = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).drop("nth")
        edge = F.lit(chosen[-1])
        open_ = wanted.where(F.col("bound") > edge if later else F.col("bound") < edge)
        short = open_.join(out.groupBy("vehicle_id").agg(F.count("*").alias("have")).where(F.col("have") >= n), "vehicle_id", "left_anti")
        if short.isEmpty():
            break
    return out.select(*COLUMNS)


def folded(summary: DataFrame, rows: DataFrame, sim_date: str) -> DataFrame:
    """Rows of a date after all stored ones, with their trend from the summary alone."""
    s = summary.select("vehicle_id", "last_net", "before_net")
    a, b, c = F.col("before_net"), F.col("last_net"), F.col("net_profit")
    # A vehicle's first two rows have no trend: two points are none.
    losses = sum(((x < 0).cast("int") for x in (a, b)), (c < 0).cast("int"))
    trend = F.coalesce(((a > b) & (b > c)) | (losses >= 2), F.lit(False))
    return rows.join(s, "vehicle_id", "left").withColumn("becoming_unprofitable", trend).drop("last_net", "before_net")


def advanced(summary: DataFrame, rows: DataFrame) -> DataFrame:
    """The summary after rows of a later date: mergeable, whatever came before."""
    new = rows.select("vehicle_id", F.col("sim_date").alias("at"), F.col("net_profit").alias("net"))
    j = summary.join(new, "vehicle_id", "full")
    first, last = F.coalesce("first_date", "at"), F.coalesce("at", "last_date")
    return j.select("vehicle_id", first.alias("first_date"), last.alias("last_date"), F.coalesce("net", "last_net").alias("last_net"), F.when(F.col("net").isNull(), F.col("before_net")).otherwise(F.col("last_net")).alias("before_net"))


def summarised(rows: DataFrame) -> DataFrame:
    """The summary of any stored rows of whole vehicles."""
    last = F.row_number().over(Window.partitionBy("vehicle_id").orderBy(F.desc("sim_date")))
    two = rows.select("vehicle_id", "sim_date", "net_profit").withColumn("nth", last)
    return two.groupBy("vehicle_id").agg(
        F.min("sim_date").alias("first_date"), F.max("sim_date").alias("last_date"),
        F.max(F.when(F.col("nth") == 1, F.col("net_profit"))).alias("last_net"), F.max(F.when(F.col("nth") == 2, F.col("net_profit"))).alias("before_net"),
    )


def replace_date(table: Snapshots, rows: DataFrame, sim_date: str, run_id: str) -> tuple[int, list[str]]:
    """Store a date's reconciled rows with trend; (new version, dates rewritten).

    A date after all stored ones is folded onto the summary. For a date among them, each
    vehicle's two rows before it and two rows after it are found, the trend of the date and of
    the later rows is made anew, and later dates are rewritten where a trend has changed. So
    are those of vehicles that the date has lost.
    """
    version = table.manifest()["version"]
    held = table.manifest(version)["dates"]
    summary = table.side("summary", SUMMARY, version)
    if not held or sim_date > max(held):
        own = folded(summary, rows, sim_date).select(*COLUMNS)
        return table.replace(own, [sim_date], run_id, {"summary": advanced(summary, rows)}, version), [sim_date]
    old = table.read(version, [sim_date])
    ids = rows.select("vehicle_id").unionByName(old.select("vehicle_id")).distinct().join(summary, "vehicle_id", "left")
    before = nearest_rows(table, version, sim_date, ids.select("vehicle_id", F.coalesce("first_date", F.lit(sim_date)).alias("bound")), False)
    after = nearest_rows(table, version, sim_date, ids.select("vehicle_id", F.coalesce("last_date", F.lit(sim_date)).alias("bound")), True)
    plain = rows.withColumn("becoming_unprofitable", F.lit(False)).select(*COLUMNS)
    near = E.with_trend(reduce(DataFrame.unionByName, (before, plain, after))).select("sim_date", "vehicle_id", F.col("becoming_unprofitable").alias("trend"))
    changed = after.join(near, ["sim_date", "vehicle_id"]).where(F.col("trend") != F.col("becoming_unprofitable"))
    dates = sorted({sim_date, *[r["sim_date"] for r in changed.select("sim_date").distinct().collect()]})
    others = table.read(version, [d for d in dates if d != sim_date])
    both = plain.unionByName(others).join(near, ["sim_date", "vehicle_id"], "left")
    own = both.withColumn("becoming_unprofitable", F.coalesce("trend", "becoming_unprofitable")).select(*COLUMNS)
    # The summary changes for vehicles whose last two rows, or first row, the date touches.
    span = reduce(DataFrame.unionByName, (before, plain, after)).select("vehicle_id", "sim_date", "net_profit")
    fresh = summarised(span).join(ids.select("vehicle_id", F.col("first_date").alias("f"), F.col("last_date").alias("l"), F.col("last_net").alias("ln"), F.col("before_net").alias("bn")), "vehicle_id")
    far = (F.col("l") > sim_date) & (F.col("l") > F.col("last_date"))  # more than two rows lie after the date
    first = F.when(F.col("f").isNull() | (F.col("f") >= sim_date), F.col("first_date")).otherwise(F.least("f", "first_date"))
    fresh = fresh.select("vehicle_id", first.alias("first_date"), F.when(far, F.col("l")).otherwise(F.col("last_date")).alias("last_date"), F.when(far, F.col("ln")).otherwise(F.col("last_net")).alias("last_net"), F.when(far, F.col("bn")).otherwise(F.col("before_net")).alias("before_net"))
    kept = summary.join(ids.select("vehicle_id"), "vehicle_id", "left_anti")
    return table.replace(own, dates, run_id, {"summary": kept.unionByName(fresh)}, version), dates


def run_date(stores: Stores, sim_date: str, version: int, run_id: str, now: Callable[[], Column] | None = None, p: Params = DEFAULT) -> str:
    """Reconcile one date from one version of its file; "success" or "failed" (a file that isn't
    there, is empty or too bad). Any other error is logged as a failure too and raised.

    Repeated with the same ``run_id`` it replaces what it wrote. Bad lines are kept in
    quarantine also where the file is refused; the table then stays as it is.
    """
    spark, clock = stores.spark, now or (lambda: F.current_timestamp().cast("timestamp_ntz"))
    took: dict[str, float] = {}

    @contextmanager
    def timed(task: str) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            took[task] = round(time.monotonic() - began, 3)

    def finish(status: str, quarantined: int | None = None, notes: str | None = None) -> str:
        H.append_runs(H.run_finished(spark, run_id, status, clock(), quarantined, notes, took), stores.runs)
        return status

    files = landing.listing(spark, stores.landing).where((F.col("sim_date") == sim_date) & (F.col("version") == version))
    late = not landing.late(files, p).isEmpty()
    H.append_runs(H.run_started(spark, run_id, sim_date, version, clock(), late), stores.runs)
    try:
        with timed("validate"):
            lines = landing.expense_file(spark, stores.landing, sim_date, version)
            if lines is None:
                return finish("failed", notes=f"no expense file of {sim_date} in version {version}")
            jobs.quarantine(E.quarantined(lines, stores.roster, F.lit(run_id)), stores.quarantine)
            verdict = E.gate(lines, stores.roster, p, lines.sparkSession.createDataFrame([(sim_date, version)], "sim_date string, version int")).first()
        if not verdict["accepted"]:
            return finish("failed", verdict["invalid"], E.refusal(verdict["total"], verdict["invalid_ratio"], p))
        with timed("reconcile"):
            days = T.vehicle_day(archive_day(stores, sim_date), p)
            costs = E.clean(lines, stores.roster)
            rec = E.reconciled(days, costs, p).withColumn("expense_file_version", F.lit(version)).withColumn("run_id", F.lit(run_id))
        with timed("replace"):
            replace_date(stores.table, rec, sim_date, run_id)
        with timed("report"):
            landing.write_report(stores.table.read(dates=[sim_date]), stores.reports)
        return finish("success", verdict["invalid"])
    except Exception as e:
        finish("failed", notes=str(e)[:2000])
        raise


def run_pending(stores: Stores, now: Column, clock: Callable[[], Column] | None = None, p: Params = DEFAULT) -> list[tuple[str, int, str]]:
    """Run every closed date with a newer file than was processed, oldest first, each once;
    (date, version, status). A file that was refused is tried again on the next call."""
    files = landing.newest(landing.listing(stores.spark, stores.landing))
    done = H.processed_versions(H.run_log_latest(run_log(stores)))
    todo = sorted((r["sim_date"], r["version"]) for r in S.pending_dates(files, done, now, p).collect())
    return [(d, v, run_date(stores, d, v, f"{d}_v{v}", clock, p)) for d, v in todo]
