"""The audit trail: newest dashboard sessions of ordinary users, with names."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardpulse.functions.calendar import LOCAL_ZONE, to_local
from boardpulse.functions.text import joined_names, or_default, time_label
from boardpulse.operators.links import UNLINKED, display_names
from boardpulse.operators.nesting import positions_per_user
from boardpulse.operators.newest import newest_rows
from boardpulse.operators.scope import is_admin
from boardpulse.session import pin
from boardpulse.sources.tables import Tables
from boardpulse.sources.zones import Zone
from boardpulse.streaming.rollup import LOGIN_PORTAL

# Rows taken before filtering, rows shown, name for the nameless.
LOG_LIMIT = 500
RECENT_LIMIT = 15
NAMELESS_USER = "Usuario Desconocido"


def _newest_first() -> list:
    return [F.desc_nulls_first("last_ping"), F.desc("id")]


def audit_log(
    tables: Tables,
    start_date: date | None = None,
    end_date: date | None = None,
    user_id: int | None = None,
    position_id: int | None = None,
    dashboard_name: str | None = None,
    limit: int | None = LOG_LIMIT,
    zones: Sequence[Zone] | None = None,
) -> DataFrame:
    """Newest sessions by last ping, then stripped of logins, admins and other dashboards.

    Day and user filters choose before the limit, everything else after it, so fewer
    than ``limit`` rows may remain. Absent days are unbounded; without a limit the log is
    complete. Sessions without a page stay in the log under the name for unlinked pages.
    With the ``zones`` of stored facts only the newest days are opened.
    """
    only = None if user_id is None else F.col("user_id") == user_id
    if limit is not None and zones is not None:
        newest, _ = newest_rows(tables.session_source, zones, limit, _newest_first(), (start_date, end_date), only)
    else:
        facts = tables.sessions((start_date, end_date)) if start_date or end_date else tables.sessions()
        if only is not None:
            facts = facts.where(only)
        newest = facts if limit is None else pin(facts.orderBy(*_newest_first()).limit(limit))

    people = tables.users.where(~is_admin(F.col("role"))).select(
        F.col("id").alias("_user"), or_default(F.col("name"), NAMELESS_USER).alias("name")
    )
    log = people.join(
        newest.where(~F.col("dashboard_url").eqNullSafe(LOGIN_PORTAL)), F.col("_user") == F.col("user_id")
    )
    names = display_names(tables.dashboard_links, tables.dashboard_types)
    log = log.join(names, F.col("dashboard_url") == F.col("_url"), "left").withColumn(
        "dashboard_name", F.coalesce("dashboard_name", F.lit(UNLINKED))
    )
    if dashboard_name:
        log = log.where(F.col("dashboard_name") == dashboard_name)

    seen = newest.select(F.col("user_id").alias("_seen")).distinct()
    held = tables.user_positions.join(seen, F.col("user_id") == F.col("_seen"), "left_semi")
    bundles = positions_per_user(held, tables.positions).select(
        F.col("_user").alias("_holder"), "positions"
    )
    log = log.join(bundles, F.col("user_id") == F.col("_holder"), "left").withColumn(
        "positions", F.coalesce("positions", F.array())
    )
    if position_id is not None:
        log = log.where(F.exists("positions", lambda item: item["id"] == position_id))
    return log.select(
        "id",
        "name",
        "start_time",
        "last_ping",
        F.coalesce("duration_minutes", F.lit(0)).alias("duration_minutes"),
        "dashboard_url",
        "dashboard_name",
        joined_names(F.col("positions"), keep_blank=False).alias("position_name"),
    ).orderBy(*_newest_first())


def recent_activity(log: DataFrame, zone: str = LOCAL_ZONE, limit: int = RECENT_LIMIT) -> DataFrame:
    """The first rows of a log in display form; a length of zero shows as one."""
    minutes = F.col("duration_minutes")
    return (
        log.where(~F.col("dashboard_url").eqNullSafe(LOGIN_PORTAL))
        .orderBy(*_newest_first())
        .limit(limit)
        .select(
            "id",
            "name",
            "position_name",
            "dashboard_name",
            F.when(minutes.isNull() | (minutes == 0), 1).otherwise(minutes).alias("minutes"),
            time_label(to_local(log, "start_time", zone)).alias("time_label"),
        )
    )
