"""Explicit schemas of the domain tables. Secrets have no place in any of them."""

from __future__ import annotations

from pyspark.sql import types as T

USERS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("username", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("role", T.StringType()),
    ]
)

POSITIONS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("can_view_metrics", T.BooleanType()),
    ]
)

USER_POSITIONS = T.StructType(
    [
        T.StructField("user_id", T.LongType(), False),
        T.StructField("position_id", T.LongType(), False),
    ]
)

DASHBOARD_TYPES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)

DASHBOARD_LINKS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("position_id", T.LongType()),
        T.StructField("dashboard_type_id", T.LongType()),
        T.StructField("url", T.StringType()),
    ]
)

SESSIONS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("user_id", T.LongType()),
        T.StructField("dashboard_url", T.StringType()),
        T.StructField("session_date", T.DateType()),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("last_ping", T.TimestampType()),
        T.StructField("duration_minutes", T.LongType()),
    ]
)

PINGS = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("dashboard_url", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

ACCESS_LOG = T.StructType(
    [
        T.StructField("key", T.LongType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

# One row of the load file: a user, and the position to give them by name.
SEED_USERS = T.StructType(
    [
        T.StructField("username", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("position_name", T.StringType()),
    ]
)

DOMAIN = {
    "users": USERS,
    "positions": POSITIONS,
    "user_positions": USER_POSITIONS,
    "dashboard_types": DASHBOARD_TYPES,
    "dashboard_links": DASHBOARD_LINKS,
    "activity_sessions": SESSIONS,
}

# Columns older layouts still carry, by table.
LEGACY_COLUMNS = {
    "positions": ("dashboard_name", "dashboard_url"),
    "users": ("position_id",),
}
