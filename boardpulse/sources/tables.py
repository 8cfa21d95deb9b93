"""The domain tables as one bundle of lazy DataFrames, and their storage layout."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardpulse.functions.calendar import DayRange, within_days
from boardpulse.sources import schemas

# Names of version folders, and of the file that says a version is complete.
VERSION = "version-"
COMPLETE = "_COMPLETE"

SessionSource = Callable[[Sequence[DayRange]], DataFrame]


@dataclass(frozen=True)
class Tables:
    """Everything a plan reads.

    Session facts come through a function of the wanted day ranges, so that each layout
    can prune in its own way: stored facts by partition, facts rolled up on the fly by
    the instants of the raw feed.
    """

    users: DataFrame
    positions: DataFrame
    user_positions: DataFrame
    dashboard_types: DataFrame
    dashboard_links: DataFrame
    session_source: SessionSource

    def sessions(self, *ranges: DayRange) -> DataFrame:
        """Session facts of the given inclusive day ranges, of all days without any."""
        return self.session_source(ranges)

    def with_sessions(self, frame: DataFrame) -> Tables:
        return replace(self, session_source=from_frame(frame))

    @property
    def spark(self) -> SparkSession:
        return self.users.sparkSession


def from_frame(frame: DataFrame) -> SessionSource:
    """Session source over a frame that has ``session_date`` as a column or partition."""

    def select(ranges: Sequence[DayRange]) -> DataFrame:
        if not ranges:
            return frame
        return frame.where(within_days(F.col("session_date"), ranges))

    return select


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One domain table under its fixed schema; any built-in file format.

    Only the listed columns are read, which keeps stored secrets out of every plan.
    """
    reader = spark.read.format(fmt).schema(schemas.DOMAIN[name])
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def read_tables(spark: SparkSession, root: str, fmt: str = "parquet") -> Tables:
    """All domain tables of the newest complete version under ``root``, or stored as ``root/<table>``."""
    versions = complete_versions(spark, root)
    root = os.path.join(root, versions[-1]) if versions else root
    frames = {
        name: read_table(spark, os.path.join(root, name), name, fmt) for name in schemas.DOMAIN
    }
    sessions = frames.pop("activity_sessions")
    return Tables(**frames, session_source=from_frame(sessions))


def complete_versions(spark: SparkSession, root: str) -> list[str]:
    """Version folders whose tables were all written, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    names = [status.getPath().getName() for status in system.listStatus(path)]
    marked = [n for n in names if n.startswith(VERSION) and system.exists(spark._jvm.org.apache.hadoop.fs.Path(path, f"{n}/{COMPLETE}"))]
    return sorted(marked)


def write_tables(tables: Tables, root: str) -> str:
    """Store all tables as a new version under ``root`` and return its name.

    The version counts only once every table is written, so a job that fails half-way, or
    one that reads the version before it, leaves that one whole. Old versions stay until
    somebody removes them.
    """
    spark = tables.spark
    version = f"{VERSION}{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    folder = os.path.join(root, version)
    for name in schemas.DOMAIN:
        if name != "activity_sessions":
            getattr(tables, name).write.parquet(os.path.join(folder, name))
    write_sessions(tables.sessions(), os.path.join(folder, "activity_sessions"))
    mark = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(folder, COMPLETE))
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark).close()
    return version


def write_sessions(sessions: DataFrame, path: str, replace_all: bool = False) -> None:
    """Write facts partitioned by day; the days supplied replace the stored ones, others stay.

    The rebalance hint gathers each day into well-sized files, yet lets the engine split
    a day that is too big for one task. ``replace_all`` drops the days not supplied.
    """
    writer = sessions.hint("rebalance", "session_date").write.mode("overwrite").partitionBy("session_date")
    writer.option("partitionOverwriteMode", "static" if replace_all else "dynamic").parquet(path)


def drop_legacy_columns(frame: DataFrame, table: str) -> DataFrame:
    """Remove the columns an older layout may still carry; absent ones are no matter."""
    return frame.drop(*schemas.LEGACY_COLUMNS.get(table, ()))
