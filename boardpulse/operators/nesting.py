"""To-many relations as nested arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def positions_per_user(user_positions: DataFrame, positions: DataFrame) -> DataFrame:
    """Each user's existing positions ordered by id, and whether one shows the metrics.

    A list is as long as the positions one user holds, pairs being unique.
    """
    held = user_positions.join(
        positions.withColumnRenamed("id", "_position"),
        F.col("position_id") == F.col("_position"),
    )
    item = F.struct(F.col("_position").alias("id"), "name", "can_view_metrics")
    return held.groupBy(F.col("user_id").alias("_user")).agg(
        F.sort_array(F.collect_list(item)).alias("positions"),
        F.coalesce(F.bool_or("can_view_metrics"), F.lit(False)).alias("can_view_metrics"),
    )


def with_positions(users: DataFrame, user_positions: DataFrame, positions: DataFrame) -> DataFrame:
    """Users with their positions; an empty array for those without."""
    bundles = positions_per_user(user_positions, positions)
    return users.join(bundles, F.col("id") == F.col("_user"), "left").select(
        *[users[name] for name in users.columns],
        F.coalesce("positions", F.array()).alias("positions"),
        F.coalesce("can_view_metrics", F.lit(False)).alias("can_view_metrics"),
    )
