"""Recompute of reconciled dates when a newer expense file arrives or a date is forced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import expenses as E
from ..operators import serving as S
from ..params import DEFAULT, Params
from ..sources import landing
from ..streaming import jobs

KEPT = ("trips", "revenue", "gps_km", "total_cost", "net_profit", "margin", "mismatch_pct", *S.FLAGS)


def reconcile(days: DataFrame, lines: DataFrame, roster: DataFrame, versions: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Reconciled rows with trend of the dates in ``versions`` (sim_date, version), each from that
    version of its expense file."""
    costs = E.clean(lines.join(versions, ["sim_date", "version"], "left_semi"), roster)
    rec = E.with_trend(E.reconciled(days.join(versions, "sim_date", "left_semi"), costs, p))
    return rec.join(versions, "sim_date").select("sim_date", "vehicle_id", *KEPT, F.col("version").alias("source_version"))


def recompute(root: str, days: DataFrame, lines: DataFrame, roster: DataFrame, processed: DataFrame, now: Column, forced: list[str] | None = None, p: Params = DEFAULT, files: DataFrame | None = None) -> list[str]:
    """Bring the table at ``root`` (by sim_date) up to date; returns the dates that it rewrote.

    Dates to do are closed ones with a newer file than ``processed`` (sim_date,
    processed_version), or exactly ``forced``; a file with too many invalid lines is left out.
    All are done in one plan. The trend looks back two rows of a vehicle, so every date with
    such a row after a date to do is rewritten too. Only dates travel to the driver. ``files``
    (sim_date, version) lists the files where they can be told without reading them. For one date
    at a time, with verdict, versions and a cost that doesn't grow with history, see ``daily``.
    """
    newest = landing.newest(lines.select("sim_date", "version") if files is None else files)
    if forced is None:
        todo = S.pending_dates(newest, processed, now, p)
    else:
        todo = newest.where(F.col("sim_date").isin(forced))
    accepted = E.gate(lines.join(todo, ["sim_date", "version"], "left_semi"), roster, p).where("accepted")
    todo = accepted.select("sim_date", "version")
    kept = processed.join(todo, "sim_date", "left_anti").select("sim_date", F.col("processed_version").alias("version"))
    rec = reconcile(days, lines, roster, kept.unionByName(todo), p)
    w = Window.partitionBy("vehicle_id").orderBy("sim_date")
    own = rec.join(F.broadcast(todo.select("sim_date", F.lit(True).alias("own"))), "sim_date", "left").withColumn("own", F.coalesce("own", F.lit(False)))
    touched = own.withColumn("hit", F.max("own").over(w.rowsBetween(-2, 0))).where("hit").select("sim_date").distinct()
    dates = sorted(r["sim_date"] for r in touched.collect())
    if dates:
        jobs.replace_dates(rec, root, dates)
    return dates
