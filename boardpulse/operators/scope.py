"""Who and what counts: admin, position and user restrictions as set joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the role with full rights.
ADMIN = "admin"


def is_admin(role: Column) -> Column:
    """True for admins, false for everybody else, an unknown role included."""
    return F.coalesce(role == ADMIN, F.lit(False))


def drop_admins(frame: DataFrame, users: DataFrame, user_column: str = "user_id") -> DataFrame:
    """Rows of non-admins, by the rules of ``NOT IN``.

    A NULL user is dropped as soon as one admin exists. An equality anti join leaves the
    engine free to broadcast or shuffle by size, which a null-aware one is not.
    """
    admins = users.where(is_admin(F.col("role"))).select(F.col("id").alias("_admin"))
    known = frame.where(F.col(user_column).isNotNull() | ~admins.exists())
    return known.join(admins, F.col(user_column) == F.col("_admin"), "left_anti")


def holders_of(
    frame: DataFrame, user_positions: DataFrame, position_id: int, user_column: str = "user_id"
) -> DataFrame:
    """Rows of users who hold a position."""
    holders = user_positions.where(F.col("position_id") == position_id).select(
        F.col("user_id").alias("_holder")
    )
    return frame.join(holders, F.col(user_column) == F.col("_holder"), "left_semi")


def restrict_users(
    frame: DataFrame,
    user_positions: DataFrame,
    position_id: int | None = None,
    user_id: int | None = None,
    user_column: str = "user_id",
) -> DataFrame:
    """Apply only those user restrictions that are set."""
    if user_id is not None:
        frame = frame.where(F.col(user_column) == user_id)
    if position_id is not None:
        frame = holders_of(frame, user_positions, position_id, user_column)
    return frame
