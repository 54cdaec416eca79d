"""Idle spells day by day: a new day is folded onto the spells that were open before it.

What is carried is one row a vehicle at most, so a day costs that day's events and the vehicles,
not the vehicles' whole lives; the spells of all days together equal ``idle_islands`` of all
events at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..params import DEFAULT, Params

#: The open spell of a vehicle whose last event was idle.
CARRIED = "vehicle_id string, idle_since timestamp_ntz, opened_at timestamp_ntz, last_idle_at timestamp_ntz, events long"
SPELL = "vehicle_id string, idle_since timestamp_ntz, opened_at timestamp_ntz, last_idle_at timestamp_ntz, closed_at timestamp_ntz, idle_min double, events long, alert boolean, status string"


def _spells(carried: DataFrame, events: DataFrame, p: Params) -> DataFrame:
    """(vehicle_id, spell, ..., closed_at) of the day's events, spell 0 being the carried one."""
    w = Window.partitionBy("vehicle_id").orderBy("event_time", "event_id")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    before = carried.select("vehicle_id", F.col("idle_since").alias("c_since"), F.col("opened_at").alias("c_opened"))
    e = events.select("vehicle_id", "event_time", "event_id", "status").join(before, "vehicle_id", "left")
    idle = F.col("status") == "idle"
    last = F.lag("status").over(w)
    # The first event of the day goes on with the carried spell, if there is one.
    starts = idle & F.when(last.isNull(), F.col("c_since").isNull()).otherwise(last != "idle")
    e = e.withColumn("start", starts).withColumn("first", last.isNull()).withColumn("next_time", F.lead("event_time").over(w))
    e = e.withColumn("spell", F.sum(F.col("start").cast("int")).over(so_far))
    since = F.last(F.when(F.col("start"), F.col("event_time")), ignorenulls=True).over(so_far)
    e = e.withColumn("since", F.when(F.col("spell") == 0, F.col("c_since")).otherwise(since))
    # A carried spell ends at the day's first event if that isn't idle: such a row stands for it.
    ends = F.col("first") & ~idle & F.col("c_since").isNotNull()
    e = e.where(idle | ends).withColumn("ends", ends)
    opened = F.when(idle & (X.minutes_between(F.col("since"), F.col("event_time")) >= p.idle_alert_min), F.col("event_time"))
    return e.groupBy("vehicle_id", "spell").agg(
        F.min("since").alias("since"), F.min(F.when(F.col("spell") == 0, F.col("c_opened"))).alias("c_opened"), F.min(opened).alias("opened"), F.max(F.when(~F.col("ends"), F.col("event_time"))).alias("last"),
        F.max(F.when(F.col("ends"), F.col("event_time"))).alias("ended"), (F.count("next_time") == F.count("*")).alias("over"), F.max("next_time").alias("next"), F.count_if(~F.col("ends")).alias("n"),
    )


def fold_day(carried: DataFrame, events: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Spells that end in the day's clean events, and those that are open after it (``status``).

    ``carried`` are the open ones of before; a vehicle without events keeps its own. An alert
    opens and a spell closes as in ``idle_islands``.
    """
    day = _spells(carried, events, p)
    old = carried.select("vehicle_id", F.lit(0).cast("long").alias("spell"), "idle_since", "opened_at", "last_idle_at", "events")
    j = day.join(old, ["vehicle_id", "spell"], "full")
    closed = F.coalesce("ended", F.when(F.col("over"), F.col("next")))
    out = j.select(
        "vehicle_id", F.coalesce("idle_since", "since").alias("idle_since"), F.coalesce("opened_at", "c_opened", "opened").alias("opened_at"), F.coalesce("last", "last_idle_at").alias("last_idle_at"),
        closed.alias("closed_at"), (F.coalesce("n", F.lit(0)) + F.coalesce("events", F.lit(0))).cast("long").alias("events"),
    )
    out = out.withColumn("idle_min", F.round(X.minutes_between(F.col("idle_since"), F.coalesce("closed_at", "last_idle_at")), 2))
    out = out.withColumn("alert", F.col("opened_at").isNotNull()).withColumn("status", F.when(F.col("closed_at").isNull(), "open").otherwise("closed"))
    return out.select(*[c.split(" ")[0] for c in SPELL.split(", ")])


def open_spells(folded: DataFrame) -> DataFrame:
    """What the next day carries on."""
    return folded.where("status = 'open'").select(*[c.split(" ")[0] for c in CARRIED.split(", ")])
