"""Declared schemas, vocabularies and reason codes."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_TYPES = ("ping", "trip_start", "trip_end")
STATUSES = ("idle", "enroute", "on_trip")

EVENT_FIELDS = [
    ("event_id", T.StringType(), True),
    ("event_type", T.StringType(), True),
    ("trip_id", T.StringType(), False),
    ("driver_id", T.StringType(), True),
    ("vehicle_id", T.StringType(), True),
    ("lat", T.DoubleType(), True),
    ("lon", T.DoubleType(), True),
    ("speed", T.DoubleType(), True),
    ("status", T.StringType(), True),
    ("fare", T.DoubleType(), True),
    ("timestamp", T.StringType(), True),
    ("schema_version", T.IntegerType(), True),
]
EVENT = T.StructType([T.StructField(n, t, True) for n, t, _ in EVENT_FIELDS])
REQUIRED = [n for n, _, needed in EVENT_FIELDS if needed]

EXPENSE_COLUMNS = ["date", "vehicle_id", "fuel_cost", "maintenance_cost", "distance_covered", "service_flag"]
EXPENSE = T.StructType([T.StructField(n, T.StringType(), True) for n in EXPENSE_COLUMNS])
