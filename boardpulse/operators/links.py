"""The two meanings of a session's URL: every dashboard type it shows, or one display name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardpulse.functions.text import or_default

# Dashboard names kept out of rankings, and names for what is not linked.
RESERVED_NAMES = ("Portal/login", "Admin")
NAMELESS_TYPE = "Desconocido"
UNLINKED = "General"


def url_types(links: DataFrame) -> DataFrame:
    """Distinct (url, type): the same page on many positions counts once per type."""
    return links.select("url", "dashboard_type_id").distinct()


def url_weights(
    links: DataFrame, types: DataFrame | None = None, dashboard_name: str | None = None
) -> DataFrame:
    """How often a session on a URL counts, for URLs that differ from the default.

    Without a name a page counts once per type, and once if nobody linked it; only pages
    of several types are listed. With a name it counts once per type so named; pages
    without one count for nothing and are not listed. Joining one weight per listed URL
    gives the sums of the joined-out rows, yet the facts do not grow and the side joined
    to them is far smaller than the link table.
    """
    pairs = url_types(links)
    if dashboard_name is not None:
        named = types.where(F.col("name") == dashboard_name).select(F.col("id").alias("_type"))
        pairs = pairs.join(named, F.col("dashboard_type_id") == F.col("_type"), "left_semi")
    weights = pairs.groupBy(F.col("url").alias("_url")).agg(F.count("*").alias("weight"))
    return weights if dashboard_name is not None else weights.where(F.col("weight") > 1)


def names_of_urls(links: DataFrame, types: DataFrame) -> DataFrame:
    """Each URL with every reportable dashboard name behind it, one row per type."""
    reportable = types.where(~F.col("name").isin(*RESERVED_NAMES)).select(
        F.col("id").alias("_type"), "name"
    )
    return (
        url_types(links)
        .join(reportable, F.col("dashboard_type_id") == F.col("_type"))
        .select(F.col("url").alias("_url"), "name")
    )


def display_names(links: DataFrame, types: DataFrame) -> DataFrame:
    """Each URL with the one name shown for it: that of its newest link."""
    named = links.join(
        types.select(F.col("id").alias("_type"), "name"),
        F.col("dashboard_type_id") == F.col("_type"),
        "left",
    )
    return named.groupBy(F.col("url").alias("_url")).agg(
        F.max_by(or_default(F.col("name"), NAMELESS_TYPE), "id").alias("dashboard_name")
    )
