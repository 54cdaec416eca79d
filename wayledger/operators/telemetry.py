"""Validation, deduplication, hops, durations, windows and idle spells of telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..params import DEFAULT, Params
from ..schemas import EVENT


def parse(rows: DataFrame, value: str = "value") -> DataFrame:
    """Permissive JSON parse: a wrong-typed field is null, broken text nulls all of them."""
    # A generator, as a filter on a field isn't moved below it: below a plain column it would parse
    # the text again for every field that it names.
    once = F.inline(F.array(F.from_json(F.col(value).cast("string"), EVENT)))
    return rows.select(once, F.col(value).cast("string").alias("raw_value"), *[c for c in rows.columns if c != value])


def with_event_time(events: DataFrame) -> DataFrame:
    """``event_time`` from ISO text; a bad value is null."""
    return events.withColumn("event_time", F.expr("try_to_timestamp(timestamp)").cast("timestamp_ntz"))


def archived(wire: DataFrame) -> DataFrame:
    """What the archive keeps of source rows, a table or a stream: the parsed fields, the raw
    text, where and when it came from, event time, and the event's date as partition."""
    e = with_event_time(parse(wire, "value"))
    return e.withColumn("ingested_at", F.current_timestamp()).withColumn("sim_date", X.sim_date(F.col("event_time")))


def of_date(archive: DataFrame, date: str) -> DataFrame:
    """One day of the archive: its partition alone is read, and rows whose event lies in
    another day (written under a wrong date) are left out. An absent day has no rows."""
    return archive.where((F.col("sim_date") == date) & X.in_day(F.col("event_time"), F.lit(date)))


def guarded(archive: DataFrame) -> DataFrame:
    """All days of the archive without rows whose event lies in another day."""
    return archive.where(F.col("sim_date") == X.sim_date(F.col("event_time")))


def validated(events: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return events.withColumn("reason", X.event_verdict(p))


def valid(events: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return validated(events, p).where("reason IS NULL").drop("reason")


def invalid(events: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return validated(events, p).where("reason IS NOT NULL")


#: What the figures of a day need of an event: no raw text, and of its source the offset only.
NARROW = ("event_id", "event_type", "trip_id", "driver_id", "vehicle_id", "lat", "lon", "speed", "status", "fare", "event_time", "kafka_offset", "arrival_time")


def deduplicated(events: DataFrame, *key: str) -> DataFrame:
    """The first copy of each event of a day by event time, then offset.

    Equal ids on different dates are different events, so a day's figures depend on that day
    alone, whichever other days a job reads.
    """
    first = Window.partitionBy(*(key or ("sim_date", "event_id"))).orderBy("event_time", "kafka_offset")
    return events.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def narrowed(events: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Valid events with date and zone, and without the columns that only the archive needs."""
    own = valid(events.drop("sim_date"), p)
    own = own.select(*[c for c in NARROW if c in own.columns])
    return own.withColumn("sim_date", X.sim_date(F.col("event_time"))).withColumn("zone_id", X.zone_id(F.col("lat"), F.col("lon"), p))


def clean(events: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Valid events, deduplicated in their day, with date and zone."""
    return deduplicated(narrowed(events, p))


def clustered(events: DataFrame, buckets: int, p: Params = DEFAULT) -> DataFrame:
    """The same but for ids that several vehicles share in a day, distributed by vehicle.

    One exchange of narrow rows: copies of an event lie beside each other in their vehicle's
    partition. ``shared`` finds the rows that are left over.
    """
    return deduplicated(narrowed(events, p).repartition(buckets, "vehicle_id"), "sim_date", "vehicle_id", "event_id")


def suspects(events: DataFrame) -> DataFrame:
    """Hashes of ids that occur more than once in a day: eight bytes a row are exchanged, and what
    ``shared`` is to look at is few rows, mostly none. Differing ids of one hash do no harm."""
    return events.select(_day_id()).groupBy("day_id").agg(F.count("*").alias("n")).where("n > 1").select("day_id")


def suspected(events: DataFrame, found: DataFrame) -> DataFrame:
    return events.withColumn("day_id", _day_id()).join(found, "day_id", "left_semi").drop("day_id")


def _day_id() -> Column:
    return F.xxhash64("sim_date", "event_id").alias("day_id")


def shared(events: DataFrame) -> DataFrame:
    """Rows of ``clustered`` to leave out: events whose id another vehicle used earlier that day."""
    place = F.struct("event_time", "kafka_offset", "vehicle_id")
    first = events.groupBy("sim_date", "event_id").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    return events.select("sim_date", "event_id", "vehicle_id").join(first, ["sim_date", "event_id"]).where(F.col("vehicle_id") != F.col("first.vehicle_id")).select("sim_date", "event_id", "vehicle_id")


def _by_vehicle_day() -> Window:
    return Window.partitionBy("sim_date", "vehicle_id").orderBy("event_time", "event_id")


def sequenced(events: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Previous position and next time of every event: one exchange, one sort for both.

    ``hop_km`` is null without a previous event; ``hop_kmh`` is 0 for a hop without time;
    ``gap_min`` is null for the last event of a vehicle-day.
    """
    w = _by_vehicle_day()
    e = events.select("*", F.lag("lat").over(w).alias("plat"), F.lag("lon").over(w).alias("plon"), F.lag("event_time").over(w).alias("ptime"), F.lead("event_time").over(w).alias("ntime"))
    km = X.haversine_km(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon"), p)
    hours = X.minutes_between(F.col("ptime"), F.col("event_time")) / 60
    e = e.withColumn("hop_km", F.when(F.col("ptime").isNotNull(), km)).withColumn("hop_h", hours)
    kmh = F.when(F.col("hop_h") > 0, F.col("hop_km") / F.col("hop_h")).otherwise(0.0)
    return e.withColumn("hop_kmh", F.when(F.col("ptime").isNotNull(), kmh)).withColumn("gap_min", X.minutes_between(F.col("event_time"), F.col("ntime")))


def vehicle_day(events: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The figures of every vehicle-day of archived events."""
    return day_figures(clean(events, p), p)


def day_figures(events: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """All figures of a vehicle-day of clean events in one grouped pass over one window sort.

    Revenue counts ``trip_end`` fares; distance leaves out impossible jumps; time leaves out
    gaps beyond ``max_gap_min``.
    """
    e = sequenced(events, p)
    end = F.col("event_type") == "trip_end"
    hop = F.col("hop_kmh") <= p.max_speed_kmh
    kept = F.col("gap_min") <= p.max_gap_min
    spent = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("gap_min"))), F.lit(0.0))
    out = e.groupBy("sim_date", "vehicle_id").agg(
        F.count_if(end).alias("trips"),
        F.coalesce(F.sum(F.when(end, F.col("fare"))), F.lit(0.0)).alias("revenue"),
        F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"), F.count("*").alias("events"),
        F.coalesce(F.sum(F.when(hop, F.col("hop_km"))), F.lit(0.0)).alias("gps_km"), F.count_if(hop).alias("hops"),
        spent(kept).alias("online_min"), spent(kept & (F.col("status") == "on_trip")).alias("on_trip_min"), spent(kept & (F.col("status") == "idle")).alias("idle_min"),
    )
    out = out.withColumn("utilization", X.utilization(F.col("on_trip_min"), F.col("online_min")))
    rounded = {"revenue": 2, "gps_km": 3, "online_min": 2, "on_trip_min": 2, "idle_min": 2}
    return out.withColumns({c: F.round(c, d) for c, d in rounded.items()})


def zone_hourly(events: DataFrame) -> DataFrame:
    """Tumbling hours per zone; the same expressions run on a table or a stream."""
    end = F.col("event_type") == "trip_end"
    out = events.groupBy(F.window("event_time", "60 minutes").alias("w"), "zone_id").agg(
        F.count_if(F.col("event_type") == "trip_start").alias("trips_started"), F.count_if(end).alias("trips_completed"),
        F.round(F.coalesce(F.sum(F.when(end, F.col("fare"))), F.lit(0.0)), 2).alias("earnings"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_pings") for s in ("idle", "on_trip", "enroute")], F.count("*").alias("pings"),
    )
    return out.select("zone_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.to_date("w.start").alias("sim_day"), F.hour("w.start").cast("short").alias("sim_hour"), "trips_started", "trips_completed", "earnings", "idle_pings", "on_trip_pings", "enroute_pings", "pings")


def vehicle_daily_running(events: DataFrame) -> DataFrame:
    end = F.col("event_type") == "trip_end"
    out = events.groupBy(F.window("event_time", "1 day").alias("w"), "vehicle_id").agg(F.count_if(end).alias("trips"), F.round(F.coalesce(F.sum(F.when(end, F.col("fare"))), F.lit(0.0)), 2).alias("revenue"))
    return out.select("vehicle_id", F.to_date("w.start").alias("sim_day"), "trips", "revenue")


def latest_state(events: DataFrame) -> DataFrame:
    """The newest event of each vehicle (partial aggregation, no sort)."""
    newest = F.max_by(F.struct("driver_id", "status", "zone_id", "trip_id", "lat", "lon", "speed", "event_time"), F.struct("event_time", "event_id"))
    return events.groupBy("vehicle_id").agg(newest.alias("s")).select("vehicle_id", "s.*")


def idle_islands(events: DataFrame, p: Params = DEFAULT, silence_minutes: float | None = None) -> DataFrame:
    """Runs of consecutive idle events per vehicle; an alert when one lasts long enough.

    An alert opens at the idle event that completes the time, and closes at the first event
    that isn't idle; a closed run lasts until then, an open one until its last event. Silence
    doesn't break a run unless ``silence_minutes`` is given; then the run ends at its last
    event.
    """
    w = Window.partitionBy("vehicle_id").orderBy("event_time", "event_id")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    idle = F.col("status") == "idle"
    starts = F.coalesce(F.lag("status").over(w) != "idle", F.lit(True))
    if silence_minutes is not None:
        starts = starts | (X.minutes_between(F.lag("event_time").over(w), F.col("event_time")) > silence_minutes)
    e = events.withColumn("start", (idle & starts).cast("int")).withColumn("next_time", F.lead("event_time").over(w)).withColumn("next_status", F.lead("status").over(w))
    e = e.withColumn("island", F.sum("start").over(so_far)).withColumn("since", F.last(F.when(F.col("start") == 1, F.col("event_time")), ignorenulls=True).over(so_far)).where(idle)
    reached = F.when(X.minutes_between(F.col("since"), F.col("event_time")) >= p.idle_alert_min, F.col("event_time"))
    out = e.groupBy("vehicle_id", "island").agg(
        F.min("since").alias("idle_since"), F.min(reached).alias("opened_at"), F.max("event_time").alias("last_idle_at"),
        F.max(F.when(F.col("next_status") != "idle", F.col("next_time"))).alias("moved_at"), (F.count("next_time") == F.count("*")).alias("over"), F.count("*").alias("events"),
    )
    closed_at = F.when(F.col("over"), F.coalesce("moved_at", "last_idle_at"))
    out = out.withColumn("closed_at", closed_at).withColumn("idle_min", F.round(X.minutes_between(F.col("idle_since"), F.coalesce("closed_at", "last_idle_at")), 2))
    return out.select("vehicle_id", "idle_since", "opened_at", "last_idle_at", "closed_at", "idle_min", "events", F.col("opened_at").isNotNull().alias("alert"), F.when(F.col("over"), "closed").otherwise("open").alias("status"))


def late_rows(events: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Events that a stream with this watermark would drop, from arrival order alone.

    Batches are arrival minutes. A batch sees the watermark of two batches before it, so the
    running maximum is over the small table of batches and joined back by batch.
    """
    e = events.where("event_time IS NOT NULL").withColumn("batch", F.date_trunc("minute", "arrival_time"))
    per = e.groupBy("batch").agg(F.max("event_time").alias("top"))
    w = Window.orderBy("batch")
    mark = per.select("batch", F.max("top").over(w.rowsBetween(Window.unboundedPreceding, -2)).alias("seen"))
    joined = e.join(mark, "batch")
    return joined.where(F.col("event_time") <= F.expr(f"timestampadd(MINUTE, -{p.watermark_min}, seen)")).drop("batch", "seen")


def late_in_triggers(log: DataFrame, most: int, start: Column | None = None, p: Params = DEFAULT, block: int = 4096) -> DataFrame:
    """Rows of an archived log (with ``log_partition`` and ``log_offset``) that a stream drops as
    late when it reads from the beginning, ``most`` offsets of each partition a trigger.

    A row's trigger follows from its offset alone; ``start`` is the offset its partition begins
    at (default 0). Only valid events move the watermark. The running maximum is taken within
    blocks of triggers and over the blocks, so no task sees all triggers.
    """
    e = validated(log, p).withColumn("batch", F.floor((F.col("log_offset") - (F.lit(0) if start is None else start)) / most))
    ok = F.col("reason").isNull()
    # The longest partition has rows in every trigger, so none is missing here.
    mark = watermarks(e.groupBy("batch").agg(F.max(F.when(ok, F.col("event_time"))).alias("top")), block)
    return e.where(ok).join(mark, "batch").where(F.col("event_time") <= F.expr(f"timestampadd(MINUTE, -{p.watermark_min}, seen)")).drop("batch", "seen", "reason")


def watermarks(per: DataFrame, block: int = 4096) -> DataFrame:
    """(batch, seen): the newest event time before each trigger, which is that of two triggers ago
    and earlier, from the newest of each trigger (batch, top), none of them missing."""
    per = per.withColumn("block", F.floor(F.col("batch") / block))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = per.groupBy("block").agg(F.max("top").alias("t")).select("block", F.max("t").over(before).alias("earlier"))
    within = F.max("top").over(Window.partitionBy("block").orderBy("batch"))
    return per.join(blocks, "block").select((F.col("batch") + 2).alias("batch"), F.greatest(within, "earlier").alias("seen"))


def dlq_payload(events: DataFrame, now: Column, p: Params = DEFAULT) -> DataFrame:
    """Rejected events as key and JSON value of the dead-letter sink."""
    bad = invalid(events, p)
    body = F.struct(F.col("reason").alias("error_reason"), F.col("raw_value").alias("original_payload"), now.alias("rejected_at"), "vehicle_id", "event_id")
    return bad.select(F.col("vehicle_id").alias("key"), F.to_json(body).alias("value"), "reason", "kafka_offset")
