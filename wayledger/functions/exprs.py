"""Scalar expressions as Column factories; no user-defined functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from ..schemas import EVENT_TYPES, REQUIRED, STATUSES


def in_city(lat: Column, lon: Column, p: Params = DEFAULT) -> Column:
    return lat.between(p.lat_min, p.lat_max) & lon.between(p.lon_min, p.lon_max)


def zone_id(lat: Column, lon: Column, p: Params = DEFAULT) -> Column:
    """Zone of a point: row 0 is the north, Z01 its first cell; null outside the city."""
    row = F.floor((F.lit(p.lat_max) - lat) / F.lit((p.lat_max - p.lat_min) / p.rows))
    col = F.floor((lon - F.lit(p.lon_min)) / F.lit((p.lon_max - p.lon_min) / p.cols))
    row, col = F.least(F.greatest(row, F.lit(0)), F.lit(p.rows - 1)), F.least(F.greatest(col, F.lit(0)), F.lit(p.cols - 1))
    return F.when(in_city(lat, lon, p), F.concat(F.lit("Z"), F.lpad((row * p.cols + col + 1).cast("string"), 2, "0")))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, p: Params = DEFAULT) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * p.earth_km) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def fare_for(km: Column, minutes: Column, p: Params = DEFAULT) -> Column:
    zero = F.lit(0.0)
    return F.round(p.base_fare + p.per_km * F.greatest(km, zero) + p.per_min * F.greatest(minutes, zero), 2)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, 0.0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def utilization(on_trip: Column, online: Column) -> Column:
    return F.round(F.when(online > 0, F.least(F.lit(1.0), on_trip / online)).otherwise(0.0), 4)


def round_ratio(x: Column, digits: int = 4) -> Column:
    """A quotient rounded where it is scaled, halves away from zero, as SQL engines do: one that is
    a tie in decimal digits goes where its double lies. (``round`` goes by the shortest digits.)"""
    scale = F.lit(float(10**digits))
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5).cast("double") / scale


def minutes_between(a: Column, b: Column) -> Column:
    """Minutes from a to b with microseconds."""
    return F.timestamp_diff("MICROSECOND", a, b).cast("double") / 60e6


def first_failing(rules: list[tuple[str, Column]]) -> Column:
    """The code of the first rule that holds, else null."""
    return reduce(lambda acc, rule: F.when(rule[1], F.lit(rule[0])).otherwise(acc), reversed(rules), F.lit(None).cast("string"))


def event_verdict(p: Params = DEFAULT, distinguish_unparseable: bool = True) -> Column:
    """Why an event is rejected; null for a valid one."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in REQUIRED])
    rules = [
        ("missing_field", missing),
        ("bad_event_type", ~F.col("event_type").isin(*EVENT_TYPES)),
        ("bad_status", ~F.col("status").isin(*STATUSES)),
        ("coords_out_of_bounds", ~in_city(F.col("lat"), F.col("lon"), p)),
        ("negative_speed", F.col("speed") < 0),
        ("negative_fare", F.col("fare") < 0),
        ("bad_timestamp", F.col("event_time").isNull()),
    ]
    if distinguish_unparseable:
        rules.insert(0, ("unparseable_json", F.col("event_id").isNull() & F.col("raw_value").isNotNull()))
    return first_failing(rules)


def sim_date(event_time: Column) -> Column:
    return F.coalesce(F.date_format(event_time, "yyyy-MM-dd"), F.lit("unknown"))


def flag_label() -> Column:
    """One label per vehicle-day by priority."""
    return (
        F.when(F.col("unprofitable"), "unprofitable").when(F.col("becoming_unprofitable"), "declining").when(F.col("low_margin"), "low margin")
        .when(F.col("distance_mismatch"), "distance mismatch").when(F.col("in_service"), "in service").when(F.col("missing_costs"), "no costs")
        .when(F.col("missing_telemetry"), "no telemetry").otherwise("ok")
    )


def zone_centre(zone: Column, p: Params = DEFAULT) -> tuple[Column, Column]:
    """(lat, lon) of the middle of a zone."""
    n = F.substring(zone, 2, 10).cast("long") - 1
    lat = F.lit(p.lat_max) - (F.floor(n / p.cols) + 0.5) * F.lit((p.lat_max - p.lat_min) / p.rows)
    lon = F.lit(p.lon_min) + (n % p.cols + 0.5) * F.lit((p.lon_max - p.lon_min) / p.cols)
    return lat, lon


def day_closed(day: Column, now: Column, p: Params = DEFAULT) -> Column:
    """The day (text or date) has ended and its grace for late events is over."""
    return now >= F.timestamp_add("MINUTE", F.lit(24 * 60 + p.late_grace_min), day.cast("timestamp_ntz"))


def in_day(time: Column, day: Column) -> Column:
    """The time lies in the day: from its start on, before the next one's."""
    start = day.cast("timestamp_ntz")
    return (time >= start) & (time < F.timestamp_add("DAY", F.lit(1), start))


def thousands(x: Column) -> Column:
    """Two decimals with separators; a dash for null."""
    return F.coalesce(F.format_number(x.cast("double"), 2), F.lit("-"))


def percent(x: Column) -> Column:
    """One decimal and a percent sign; a dash for null. Halves go away from zero by the decimal
    digits of the ratio: 0.5785 is 57.9%, though its hundredfold is held as 57.849999999999994."""
    return F.when(x.isNotNull(), F.format_string("%.1f%%", F.round(x.cast("double") * 100, 6))).otherwise("-")


def reasons(p: Params = DEFAULT) -> Column:
    """Texts of the flags that are set, in fixed order."""
    # The texts that the report shows.
    texts = [
        ("unprofitable", F.concat(F.lit("net profit "), F.format_string("%.2f", "net_profit"), F.lit(f" {p.currency} is negative"))),
        ("becoming_unprofitable", F.lit("net profit trending down or loss-making on 2 of the last 3 days")),
        ("low_margin", F.concat(F.lit("margin "), percent(F.col("margin")), F.lit(f" is below the {p.low_margin:.0%} threshold"))),
        ("distance_mismatch", F.concat(F.lit("GPS distance differs from reported distance by "), percent(F.col("mismatch_pct")))),
        ("in_service", F.lit("vehicle was serviced or in the garage")),
        ("missing_costs", F.lit("telemetry present but no expense row")),
        ("missing_telemetry", F.lit("expense row present but no telemetry")),
    ]
    return F.filter(F.array(*[F.when(F.col(flag), text) for flag, text in texts]), lambda x: x.isNotNull())
