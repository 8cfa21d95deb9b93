"""Deletes over whole tables: with dependants, or only where there are none."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardpulse.sources.tables import Tables


def without(frame: DataFrame, column: str, doomed: DataFrame) -> DataFrame:
    """Rows whose ``column`` is not among the ids in ``doomed``; NULLs stay."""
    ids = doomed.select(F.col(doomed.columns[0]).alias("_doomed")).distinct()
    return frame.join(ids, F.col(column) == F.col("_doomed"), "left_anti")


def purge_users(tables: Tables, doomed: DataFrame, acting_user: int | None = None) -> Tables:
    """Remove users together with their positions and sessions, never the one asking."""
    if acting_user is not None:
        doomed = doomed.where(F.col(doomed.columns[0]) != acting_user)
    return replace(
        tables,
        users=without(tables.users, "id", doomed),
        user_positions=without(tables.user_positions, "user_id", doomed),
        session_source=lambda ranges: without(tables.sessions(*ranges), "user_id", doomed),
    )


def purge_types(tables: Tables, doomed: DataFrame) -> Tables:
    """Remove dashboard types together with their links."""
    return replace(
        tables,
        dashboard_types=without(tables.dashboard_types, "id", doomed),
        dashboard_links=without(tables.dashboard_links, "dashboard_type_id", doomed),
    )


def guard_positions(tables: Tables, requested: DataFrame) -> DataFrame:
    """Requested position ids with their number of users and whether they may go."""
    ids = requested.select(F.col(requested.columns[0]).alias("position_id")).distinct()
    assigned = tables.user_positions.groupBy("position_id").agg(F.count("*").alias("assigned_users"))
    counted = ids.join(assigned, "position_id", "left").select(
        "position_id", F.coalesce("assigned_users", F.lit(0)).cast("long").alias("assigned_users")
    )
    status = F.when(F.col("assigned_users") > 0, "blocked").otherwise("deleted")
    return counted.withColumn("status", status)


def delete_positions(tables: Tables, requested: DataFrame) -> Tables:
    """Remove the requested positions nobody holds."""
    free = guard_positions(tables, requested).where(F.col("status") == "deleted")
    return replace(tables, positions=without(tables.positions, "id", free.select("position_id")))
