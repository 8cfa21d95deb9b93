"""Who holds which position, and who may open which dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardpulse.functions.text import joined_names, url_preview
from boardpulse.operators.nesting import with_positions
from boardpulse.operators.scope import holders_of, is_admin
from boardpulse.sources.tables import Tables

# Fixed value: name of a dashboard whose type is gone.
NAMELESS_DASHBOARD = "Sin Nombre"


def user_profiles(tables: Tables) -> DataFrame:
    """Each user with positions, their names (NULL without any) and the metrics right."""
    people = tables.users.select("id", "username", "name", "role")
    bundled = with_positions(people, tables.user_positions, tables.positions)
    names = F.when(F.size("positions") > 0, joined_names(F.col("positions")))
    return bundled.withColumn("position_name", names)


def metrics_viewers(tables: Tables) -> DataFrame:
    """Users who may see the report: admins, and holders of a position with the right."""
    allowed = is_admin(F.col("role")) | F.col("can_view_metrics")
    return user_profiles(tables).where(allowed).select("id", "username", "name", "role")


def user_dashboards(tables: Tables) -> DataFrame:
    """Dashboards of each user through their positions, repeated pages included."""
    types = tables.dashboard_types.select(F.col("id").alias("_type"), "name")
    links = tables.dashboard_links.join(types, F.col("dashboard_type_id") == F.col("_type"), "left")
    named = links.select(
        "position_id",
        F.col("url").alias("dashboard_url"),
        F.when(F.col("_type").isNull(), NAMELESS_DASHBOARD).otherwise(F.col("name")).alias("dashboard_name"),
    )
    return tables.user_positions.join(named, "position_id").select(
        "user_id", "dashboard_url", "dashboard_name"
    )


def user_directory(tables: Tables) -> DataFrame:
    """All users, newest first, with positions, their ids and names (empty without any)."""
    bundled = with_positions(tables.users, tables.user_positions, tables.positions)
    slim = F.transform("positions", lambda item: F.struct(item["id"].alias("id"), item["name"].alias("name")))
    return bundled.select(
        *tables.users.columns,
        slim.alias("positions"),
        F.col("positions.id").alias("position_ids"),
        joined_names(F.col("positions")).alias("position_name"),
    ).orderBy(F.desc("id"))


def link_matrix(tables: Tables) -> DataFrame:
    """Every link with the names of its position and type, and a shortened address."""
    positions = tables.positions.select(F.col("id").alias("_position"), F.col("name").alias("position_name"))
    types = tables.dashboard_types.select(F.col("id").alias("_type"), F.col("name").alias("type_name"))
    return (
        tables.dashboard_links.join(positions, F.col("position_id") == F.col("_position"), "left")
        .join(types, F.col("dashboard_type_id") == F.col("_type"), "left")
        .select(
            "id",
            "position_id",
            "dashboard_type_id",
            "url",
            "position_name",
            "type_name",
            url_preview(F.col("url")).alias("url_preview"),
        )
    )


def position_catalog(tables: Tables) -> DataFrame:
    return tables.positions.orderBy("name")


def type_catalog(tables: Tables) -> DataFrame:
    return tables.dashboard_types.orderBy(F.asc_nulls_last("name"))


def users_of_position(tables: Tables, position_id: int | None = None) -> DataFrame:
    """Users who hold a position; everybody when none is chosen."""
    if position_id is None:
        return tables.users
    return holders_of(tables.users, tables.user_positions, position_id, "id")


def types_of_position(tables: Tables, position_id: int | None = None) -> DataFrame:
    """Dashboard types linked to a position; all of them when none is chosen."""
    if position_id is None:
        return tables.dashboard_types
    linked = tables.dashboard_links.where(F.col("position_id") == position_id).select(
        F.col("dashboard_type_id").alias("_linked")
    )
    return tables.dashboard_types.join(linked, F.col("id") == F.col("_linked"), "left_semi")
