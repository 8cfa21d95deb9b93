"""Domain tables derived from the generic test tables (see FIXTURES.md)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardpulse.functions.calendar import LOCAL_ZONE, DayRange, within_instants
from boardpulse.sources.tables import Tables
from boardpulse.streaming.rollup import LOGIN_PORTAL, roll_up

URL_ROOT = "https://bi.example/r/"

# What the regions are called as dashboard types, by region key; others keep their name.
TYPE_NAMES = ["Ventas", "Stock", "Finanzas", "Admin"]

# Which report pages show which dashboard type.
PAGE_TYPES = [("click", 1), ("view", 1), ("view", 2), ("purchase", 3), ("error", 4)]


_schemas: dict[str, T.StructType] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; its schema is looked up in the file once and then reused."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def page_url(event_type="event_type"):
    return F.when(F.col(event_type) == "signup", F.lit(LOGIN_PORTAL)).otherwise(
        F.concat(F.lit(URL_ROOT), F.col(event_type))
    )


def pings(spark: SparkSession, sf_dir: str, ranges: Sequence[DayRange] = ()) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return as_pings(events.where(within_instants(events, "ts", ranges)))


def as_pings(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"), "user_id", page_url().alias("dashboard_url"), "ts"
    )


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts")


def users(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customer.select(
        key.alias("id"),
        F.lower("c_name").alias("username"),
        F.col("c_name").alias("name"),
        F.when(key % 4 != 0, F.concat(F.lower("c_name"), F.lit("@example.com"))).alias("email"),
        F.when(key % 20 == 0, "admin").otherwise("user").alias("role"),
    )


def positions(nation: DataFrame) -> DataFrame:
    return nation.select(
        F.col("n_nationkey").cast("long").alias("id"),
        F.col("n_name").alias("name"),
        (F.col("n_regionkey") == 0).alias("can_view_metrics"),
    )


def user_positions(customer: DataFrame) -> DataFrame:
    key, home = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    held = F.array(F.when(key % 10 != 9, home), F.when(key % 3 == 0, (home + 7) % 25))
    return customer.select(
        key.alias("user_id"),
        F.explode(F.filter(held, lambda position: position.isNotNull())).alias("position_id"),
    )


def dashboard_types(region: DataFrame) -> DataFrame:
    key = F.col("r_regionkey").cast("int")
    names = F.array(*[F.lit(name) for name in TYPE_NAMES])
    return region.select(
        (key + 1).cast("long").alias("id"),
        F.coalesce(F.get(names, key), F.col("r_name")).alias("name"),
        F.when(key < len(TYPE_NAMES), F.lit(None)).otherwise(F.lower("r_name")).cast("string").alias("description"),
    )


def dashboard_links(nation: DataFrame) -> DataFrame:
    """Links numbered by position, type and url.

    The pattern repeats every three positions with 4, 4 and 2 links, so the running
    number follows from the position alone and needs no global sort.
    """
    position = F.col("n_nationkey").cast("long")
    pages = F.array(
        *[F.struct(F.lit(number).cast("long").alias("type"), F.lit(URL_ROOT + page).alias("url"))
          for page, number in PAGE_TYPES]
    )
    shown = F.filter(pages, lambda page: (position + page["type"]) % 3 != 0)
    before = F.floor(position / 3) * 10 + (position % 3) * 4
    return (
        nation.select(position.alias("position_id"), before.alias("before"), F.posexplode(shown))
        .select(
            (F.col("before") + F.col("pos") + 1).cast("long").alias("id"),
            "position_id",
            F.col("col.type").alias("dashboard_type_id"),
            F.col("col.url").alias("url"),
        )
    )


def tables(spark: SparkSession, sf_dir: str, zone: str = LOCAL_ZONE) -> Tables:
    """The whole domain model, sessions rolled up from the wanted part of the feed."""
    customer, nation = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    return Tables(
        users=users(customer),
        positions=positions(nation),
        user_positions=user_positions(customer),
        dashboard_types=dashboard_types(read(spark, sf_dir, "region")),
        dashboard_links=dashboard_links(nation),
        session_source=lambda ranges: roll_up(pings(spark, sf_dir, ranges), zone),
    )
