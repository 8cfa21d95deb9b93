"""Loading and editing the user directory in bulk."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardpulse.functions.text import blank_to_null
from boardpulse.operators.changes import (
    assign_by_name,
    conflicts,
    insert_new,
    new_rows,
    replace_assignments,
    sole_changes,
    update_by_key,
    upsert,
)
from boardpulse.session import pin
from boardpulse.sources.feeds import split_by_required
from boardpulse.sources.tables import Tables

# Fixed value: what a new user must bring along.
REQUIRED = ("username", "name", "role")
TAKEN = "Username already exists"
# Reasons of refusals the database would raise on its own.
UNCLEAR = "Several changes without an order"
NO_POSITION = "Unknown position"


@dataclass(frozen=True)
class Loaded:
    """Tables after an edit, and the requests it could not carry out.

    ``refused`` lists further refusals with a reason, where an edit has any.
    """

    tables: Tables
    rejected: DataFrame
    refused: DataFrame | None = None


def load_directory(tables: Tables, positions: DataFrame, users: DataFrame) -> Loaded:
    """Load positions by name, users by username, then their pairs by both names.

    ``users`` carries username, name, role and position_name. Loading the same rows again
    changes nothing. Usernames with contradicting rows are not loaded but refused.
    """
    grown = replace(
        tables,
        positions=pin(upsert(tables.positions, positions, ["name"], id_column="id")),
        users=pin(upsert(tables.users, users.drop("position_name"), ["username"], id_column="id")),
    )
    pairs = assign_by_name(grown.user_positions, grown.users, grown.positions, users)
    unclear = conflicts(users.drop("position_name"), ["username"]).select("username", F.lit(UNCLEAR).alias("reason"))
    return Loaded(replace(grown, user_positions=pairs.user_positions), pairs.unresolved, unclear)


def enroll_users(tables: Tables, requests: DataFrame) -> Loaded:
    """Add new users with their positions.

    ``requests`` carries username, name, email, role and an array of position ids.
    Incomplete requests and taken usernames are refused with a reason.
    """
    complete, incomplete = split_by_required(requests, REQUIRED)
    cleaned = complete.withColumn("email", blank_to_null(F.col("email")))
    insertion = insert_new(tables.users.withColumn("position_ids", _no_ids()), cleaned, ["username"], "id")
    added = pin(insertion.added)
    asked = added.select("username", F.col("id").alias("user_id"), F.explode("position_ids").alias("position_id"))
    pairs, unknown = _known_positions(asked, tables)
    rejected = incomplete.select(
        "username", F.concat(F.lit("Missing required fields: "), "missing_fields").alias("reason")
    ).unionByName(
        insertion.rejected.select(
            "username", F.explode(F.array_repeat(F.lit(TAKEN), F.col("refused").cast("int"))).alias("reason")
        )
    ).unionByName(unknown.select("username", _no_position().alias("reason")))
    grown = replace(
        tables,
        users=tables.users.unionByName(added.drop("position_ids")),
        user_positions=tables.user_positions.unionByName(pairs.select("user_id", "position_id").distinct()),
    )
    return Loaded(grown, rejected)


def revise_users(tables: Tables, requests: DataFrame) -> Loaded:
    """Overwrite known users by id and give them exactly the listed positions.

    Requests for unknown ids are returned. Refused with a reason, and not written, are
    ids with contradicting requests, usernames that another user holds or several
    requests ask for, and positions nobody knows.
    """
    cleaned = requests.withColumn("email", blank_to_null(F.col("email")))
    sole = sole_changes(cleaned, ["id"])
    known = pin(sole.join(tables.users.select("id"), "id", "left_semi"))
    others = tables.users.join(known.select("id"), "id", "left_anti").select("username")
    several = known.groupBy("username").count().where("count > 1").select("username")
    taken = pin(known.join(others.unionByName(several).distinct(), "username", "left_semi").select("id", "username"))
    granted = known.join(taken.select("id"), "id", "left_anti")

    listed = granted.select(F.col("id").alias("user_id"), F.explode_outer("position_ids").alias("position_id"))
    given, unknown = _known_positions(listed.where("position_id IS NOT NULL"), tables)
    emptied = granted.select(F.col("id").alias("user_id"), F.lit(None).cast("long").alias("position_id"))
    revised = replace(
        tables,
        users=update_by_key(tables.users, granted.drop("position_ids"), ["id"]),
        user_positions=replace_assignments(tables.user_positions, given.unionByName(emptied)),
    )
    refused = (
        conflicts(cleaned, ["id"])
        .select("id", F.lit(UNCLEAR).alias("reason"))
        .unionByName(taken.select("id", F.lit(TAKEN).alias("reason")))
        .unionByName(unknown.select(F.col("user_id").alias("id"), _no_position().alias("reason")))
    )
    return Loaded(revised, new_rows(tables.users, sole, ["id"]).drop("position_ids"), refused)


def _known_positions(pairs: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Pairs whose position exists, and the others."""
    ids = tables.positions.select(F.col("id").alias("position_id"))
    return pairs.join(ids, "position_id", "left_semi"), pairs.join(ids, "position_id", "left_anti")


def _no_position():
    return F.concat(F.lit(NO_POSITION + ": "), F.col("position_id"))


def clean_positions(requests: DataFrame) -> DataFrame:
    """Position requests with a name, the metrics flag read as off unless it is on."""
    named = split_by_required(requests, ["name"])[0]
    return named.withColumn("can_view_metrics", F.coalesce("can_view_metrics", F.lit(False)))


def _no_ids():
    return F.lit(None).cast("array<long>")
