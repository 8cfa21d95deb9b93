"""Key and reference checks over whole tables, and over the days of stored facts that changed."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardpulse.session import pin
from boardpulse.sources.tables import Tables

DAY = "session_date"


def duplicates(frame: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return frame.groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Values of a reference that lead nowhere, with their number of rows.

    References are counted before the join, so a value in a third of all rows joins once.
    """
    counted = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows"))
    keys = parent.select(F.col(parent_key).alias("_key"))
    return counted.join(keys, F.col(column) == F.col("_key"), "left_anti")


def day_users(facts: DataFrame) -> DataFrame:
    """Per day and user the number of facts, and the pages that occur more than once.

    One reduction by session key carries both fact rules: a key names its day, so repeated
    keys never reach over days, and dangling users are counted from the sums.
    """
    cells = facts.groupBy(DAY, "user_id", "dashboard_url").agg(F.count("*").alias("rows"))
    again = F.when(F.col("rows") > 1, F.struct("dashboard_url", "rows"))
    return cells.groupBy(DAY, "user_id").agg(F.sum("rows").alias("rows"), F.collect_list(again).alias("again"))


def fact_findings(reduced: DataFrame, users: DataFrame) -> list[DataFrame]:
    """Repeated session keys and dangling users among reduced facts."""
    again = reduced.select("user_id", DAY, F.explode("again").alias("cell"))
    repeated = again.select("user_id", "cell.dashboard_url", DAY, "cell.rows")
    known = reduced.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.sum("rows").alias("rows"))
    keys = users.select(F.col("id").alias("_key"))
    return [
        _as_finding("sessions.key", repeated),
        _as_finding("sessions.user_id", known.join(keys, F.col("user_id") == F.col("_key"), "left_anti")),
    ]


def audit(tables: Tables) -> DataFrame:
    """Every violated key and dangling reference of the domain model, in long form. Reads the facts once."""
    findings = [
        _as_finding("users.username", duplicates(tables.users, ["username"])),
        _as_finding("positions.name", duplicates(tables.positions, ["name"])),
        _as_finding(
            "user_positions.pair", duplicates(tables.user_positions, ["user_id", "position_id"])
        ),
        _as_finding("user_positions.user_id", orphans(tables.user_positions, "user_id", tables.users)),
        _as_finding(
            "user_positions.position_id",
            orphans(tables.user_positions, "position_id", tables.positions),
        ),
        _as_finding(
            "dashboard_links.position_id",
            orphans(tables.dashboard_links, "position_id", tables.positions),
        ),
        _as_finding(
            "dashboard_links.dashboard_type_id",
            orphans(tables.dashboard_links, "dashboard_type_id", tables.dashboard_types),
        ),
        *fact_findings(pin(day_users(tables.sessions())), tables.users),
    ]
    return reduce(DataFrame.unionByName, findings)


class FactAudit:
    """The fact rules kept up to date: only days whose files changed are read again.

    A day's fingerprint is an order-free sum over the names, lengths and times of its files,
    taken from the listing alone. The reduced rows of a day are stored first and its
    fingerprint last, so a run that dies in between is repeated for that day.
    """

    PRINTS = T.StructType().add("print", T.LongType()).add("files", T.LongType()).add(DAY, T.DateType())

    def __init__(self, spark: SparkSession, facts: str, store: str, schema: T.StructType):
        self.spark, self.facts, self.store, self.schema = spark, facts, store, schema

    def _fingerprints(self) -> DataFrame:
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self.facts)
        one = F.xxhash64("path", "length", "modificationTime")
        listed = files.select(F.col(DAY).cast("date").alias(DAY), one.alias("print"))
        return listed.groupBy(DAY).agg(F.bit_xor("print").alias("print"), F.count("*").alias("files"))

    def _stored(self, name: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.store}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _write(self, frame: DataFrame, name: str) -> None:
        writer = frame.hint("rebalance", DAY).write.mode("overwrite").partitionBy(DAY)
        writer.option("partitionOverwriteMode", "dynamic").parquet(f"{self.store}/{name}")

    def refresh(self) -> list[date | None]:
        """Reduce the days that are new or changed since the last time, and return them."""
        now = pin(self._fingerprints())
        before = self._stored("prints", self.PRINTS).select(*[F.col(name).alias(f"_{name}") for name in self.PRINTS.names])
        same = F.col(DAY).eqNullSafe(F.col(f"_{DAY}")) & (F.col("print") == F.col("_print")) & (F.col("files") == F.col("_files"))
        changed = pin(now.join(before, same, "left_anti"))
        days = [row[DAY] for row in changed.select(DAY).collect()]
        if days:
            facts = self.spark.read.schema(self.schema).parquet(self.facts)
            wanted = F.col(DAY).isin([day for day in days if day is not None])
            self._write(day_users(facts.where(wanted | F.col(DAY).isNull() if None in days else wanted)), "days")
            self._write(changed.select(*self.PRINTS.names), "prints")
        return sorted(days, key=str)

    def findings(self, users: DataFrame) -> DataFrame:
        """Repeated session keys and dangling users of all days there are, as of the last refresh."""
        schema = day_users(self.spark.createDataFrame([], self.schema)).schema
        kept = self._stored("days", T.StructType([*[field for field in schema if field.name != DAY], schema[DAY]]))
        there = self._fingerprints().select(F.col(DAY).alias("_day"))
        reduced = kept.join(there, F.col(DAY).eqNullSafe(F.col("_day")), "left_semi")
        return reduce(DataFrame.unionByName, fact_findings(reduced, users))


def _as_finding(check: str, found: DataFrame) -> DataFrame:
    key = [F.col(name).cast("string") for name in found.columns if name != "rows"]
    return found.select(F.lit(check).alias("check"), F.concat_ws("|", *key).alias("key"), "rows")
