"""What is known of each day of the stored facts without reading them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardpulse.sources.tables import write_sessions

# One row per day: number of facts, number without a last ping, latest last ping in microseconds.
SCHEMA = T.StructType(
    [
        T.StructField("session_date", T.DateType()),
        T.StructField("facts", T.LongType()),
        T.StructField("nulls", T.LongType()),
        T.StructField("high", T.LongType()),
    ]
)
ZONE_DAY, FACT_DAY = "zone_day=", "session_date="
NO_DAY = FACT_DAY + "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Zone:
    """A stored day; without a ``facts`` count nothing else is known of it and it has to be read."""

    day: date
    facts: int | None = None
    nulls: int = 0
    high: int | None = None


def ping_micros() -> Column:
    return F.unix_micros(F.col("last_ping").cast("timestamp"))


def day_zones(facts: DataFrame) -> DataFrame:
    return facts.groupBy("session_date").agg(
        F.count("*").alias("facts"),
        F.count(F.when(F.col("last_ping").isNull(), 1)).alias("nulls"),
        F.max(ping_micros()).alias("high"),
    )


def write_zoned_sessions(
    sessions: DataFrame, path: str, zones: str, days: Sequence[date] | None = None
) -> None:
    """Store facts by day (see :func:`write_sessions`) and the zones of the days supplied.

    The zones of these days are taken away first and written last, from the stored files. A
    job that dies in between leaves days without a zone, which readers have to open. ``days``
    saves a pass over ``sessions`` where the caller knows them.
    """
    spark = sessions.sparkSession
    if days is None:
        days = [row["session_date"] for row in sessions.select("session_date").distinct().collect()]
    for day in days:
        path_of = spark._jvm.org.apache.hadoop.fs.Path(f"{zones}/{ZONE_DAY}{day}")
        path_of.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path_of, True)
    write_sessions(sessions, path)
    stored = spark.read.schema(sessions.schema).parquet(path).where(F.col("session_date").isin(list(days)))
    zoned = day_zones(stored).withColumn(ZONE_DAY[:-1], F.col("session_date"))
    zoned.hint("rebalance").write.mode("append").partitionBy(ZONE_DAY[:-1]).parquet(zones)


def read_zones(spark: SparkSession, path: str, zones: str) -> list[Zone] | None:
    """The stored days, one small object each; days whose zone is missing are listed as unknown.

    None where some facts have no day: then there is no order of days to follow.
    """
    if NO_DAY in _names(spark, path):
        return None
    known = {}
    if _day_folders(spark, zones, ZONE_DAY):
        rows = spark.read.schema(SCHEMA).parquet(zones).select(*SCHEMA.names).collect()
        known = {row["session_date"]: Zone(row["session_date"], row["facts"], row["nulls"], row["high"]) for row in rows}
    return [known.get(day, Zone(day)) for day in _day_folders(spark, path, FACT_DAY)]


def _names(spark: SparkSession, path: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [status.getPath().getName() for status in system.listStatus(folder)] if system.exists(folder) else []


def _day_folders(spark: SparkSession, path: str, prefix: str) -> list[date]:
    return sorted(date.fromisoformat(name[len(prefix):]) for name in _names(spark, path) if name.startswith(prefix))
