"""Snapshot plus change set gives the next snapshot: upsert, update, assign, replace."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardpulse.functions.text import is_blank
from boardpulse.operators.numbering import number_rows


def latest_changes(changes: DataFrame, key: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order_by``; the remaining columns break ties.

    A greatest struct combines before the shuffle, so a key changed a million times
    costs no more than one changed once. A row number would sort all of its rows.
    """
    rest = [name for name in changes.columns if name not in (*key, *order_by)]
    if not rest:
        return changes.select(*key).distinct()
    newest = F.max(F.struct(*order_by, *rest)).alias("_newest")
    picked = changes.groupBy(*key).agg(newest)
    return picked.select(*key, *[F.col("_newest")[name].alias(name) for name in rest])


def sole_changes(changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys with one change, however often it is repeated, and that change.

    Without an order nothing tells which of several changes is the last; their keys are
    left out here and listed by :func:`conflicts`.
    """
    rest = [name for name in changes.columns if name not in key]
    if not rest:
        return changes.select(*key).distinct()
    picked = _extremes(changes, key, rest).where(F.col("_low").eqNullSafe(F.col("_high")))
    return picked.select(*key, *[F.col("_low")[name].alias(name) for name in rest])


def conflicts(changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys with several different changes, and the number of change rows."""
    rest = [name for name in changes.columns if name not in key]
    picked = _extremes(changes, key, rest).where(~F.col("_low").eqNullSafe(F.col("_high")))
    return picked.select(*key, F.col("_rows").alias("changes"))


def _extremes(changes: DataFrame, key: Sequence[str], rest: Sequence[str]) -> DataFrame:
    row = F.struct(*rest)
    return changes.groupBy(*key).agg(F.min(row).alias("_low"), F.max(row).alias("_high"), F.count("*").alias("_rows"))


def update_by_key(snapshot: DataFrame, latest: DataFrame, key: Sequence[str]) -> DataFrame:
    """Overwrite the supplied columns of rows whose key is in ``latest``; add no rows.

    A change set small enough is broadcast by the engine and the snapshot never moves.
    """
    supplied = [name for name in latest.columns if name not in key]
    renamed = latest.select(
        *[F.col(name).alias(f"_new_{name}") for name in latest.columns], F.lit(True).alias("_hit")
    )
    match = [F.col(name) == F.col(f"_new_{name}") for name in key]
    joined = snapshot.join(renamed, match, "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{name}")).otherwise(F.col(name)).alias(name)
            if name in supplied
            else F.col(name)
            for name in snapshot.columns
        ]
    )


def new_rows(snapshot: DataFrame, latest: DataFrame, key: Sequence[str]) -> DataFrame:
    """Changes whose key the snapshot lacks.

    Keys present on both sides are found by a semi join that streams the snapshot, so
    the snapshot is shuffled only if the change set is big too.
    """
    present = snapshot.select(*key).join(latest.select(*key), list(key), "left_semi")
    return latest.join(present, list(key), "left_anti")


def upsert(
    snapshot: DataFrame,
    changes: DataFrame,
    key: Sequence[str],
    order_by: Sequence[str] = (),
    id_column: str | None = None,
) -> DataFrame:
    """Insert new keys, update known ones, and leave columns that are not supplied alone.

    With ``id_column`` new rows get the numbers after the highest one in use, in key
    order. Columns a new row does not supply are NULL. Without ``order_by`` keys with
    several different changes are left alone; :func:`conflicts` lists them.
    """
    latest = latest_changes(changes, key, order_by) if order_by else sole_changes(changes, key)
    added = _as_rows_of(snapshot, new_rows(snapshot, latest, key), key, id_column)
    return update_by_key(snapshot, latest, key).unionByName(added)


@dataclass(frozen=True)
class Insertion:
    """Outcome of adding rows that must be new."""

    added: DataFrame
    rejected: DataFrame


def insert_new(
    snapshot: DataFrame, requests: DataFrame, key: Sequence[str], id_column: str | None = None
) -> Insertion:
    """Rows to append, and the requests whose key is taken.

    Of several requests for one key the greatest is taken, the others are refused like
    those for a key already in the snapshot.
    """
    rest = [name for name in requests.columns if name not in key]
    counted = requests.groupBy(*key, *rest).agg(F.count("*").alias("_copies"))
    chosen = latest_changes(requests, key, [])
    fresh = new_rows(snapshot, chosen, key)
    matches = [counted[name].eqNullSafe(F.col(f"_in_{name}")) for name in requests.columns]
    marks = fresh.select(
        *[F.col(name).alias(f"_in_{name}") for name in requests.columns], F.lit(1).alias("_taken")
    )
    refused = F.col("_copies") - F.coalesce("_taken", F.lit(0))
    rejected = (
        counted.join(marks, matches, "left")
        .withColumn("refused", refused)
        .where(F.col("refused") > 0)
        .select(*requests.columns, "refused")
    )
    return Insertion(_as_rows_of(snapshot, fresh, key, id_column), rejected)


def _as_rows_of(
    snapshot: DataFrame, added: DataFrame, key: Sequence[str], id_column: str | None
) -> DataFrame:
    """New rows in the layout of the snapshot, numbered on from its highest id."""
    if id_column is not None:
        highest = snapshot.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("highest")).scalar()
        added = number_rows(added, key, id_column, highest)
    return added.select(
        *[
            (F.col(field.name) if field.name in added.columns else F.lit(None))
            .cast(field.dataType)
            .alias(field.name)
            for field in snapshot.schema.fields
        ]
    )


@dataclass(frozen=True)
class Assignment:
    """Outcome of loading (username, position name) rows."""

    user_positions: DataFrame
    unresolved: DataFrame


def assign_by_name(
    user_positions: DataFrame, users: DataFrame, positions: DataFrame, requests: DataFrame
) -> Assignment:
    """Resolve natural keys and add the pairs that are not there yet.

    Requests without a position name ask for nothing. Those naming an unknown user or
    position are returned instead of being loaded.
    """
    asked = requests.where(~is_blank(F.col("position_name"))).select("username", "position_name")
    resolved = asked.join(
        users.select(F.col("id").alias("user_id"), F.col("username")), "username", "left"
    ).join(
        positions.select(F.col("id").alias("position_id"), F.col("name").alias("position_name")),
        "position_name",
        "left",
    )
    known = F.col("user_id").isNotNull() & F.col("position_id").isNotNull()
    pairs = resolved.where(known).select("user_id", "position_id").distinct()
    added = new_rows(user_positions, pairs, ["user_id", "position_id"])
    return Assignment(
        user_positions.select("user_id", "position_id").unionByName(added),
        resolved.where(~known).select("username", "position_name", "user_id", "position_id"),
    )


def replace_assignments(user_positions: DataFrame, changes: DataFrame) -> DataFrame:
    """Give every user in ``changes`` exactly the positions listed there.

    A user listed with a NULL position only ends up with none.
    """
    kept = user_positions.join(changes.select("user_id").distinct(), "user_id", "left_anti")
    given = changes.where(F.col("position_id").isNotNull()).select("user_id", "position_id").distinct()
    return kept.select("user_id", "position_id").unionByName(given)
