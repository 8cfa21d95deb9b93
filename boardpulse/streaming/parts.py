"""Micro-batches stored as reduced parts, entered in a commit log and added up on read.

No state is kept between batches, nothing is ever too late, and nothing stays open at the
end of a stream: what the reader adds up is what a batch job over all rows computes.

A part is one day of one batch. The log says which parts count, so a reader opens the parts of
its days and lists no folders, however long the stream has run. Compaction merges the parts of
a day into one of the next level and retires them by a single entry; what arrives later is a
new part beside it. A day thus has at most ``fanout`` parts per level.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from boardpulse.functions.calendar import DayRange, local_day, within_days
from boardpulse.sources.commitlog import CommitLog, Entry, Part
from boardpulse.sources.feeds import event_time

# Set by Spark on the thread of a stream: stays the same when it restarts from its progress
# log and is new for a fresh log.
QUERY_ID = "sql.streaming.queryId"
# Parts of one level and day before they are merged.
FANOUT = 8
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class PartKind:
    """What a store of parts holds: its rows, how they add up, and the day each belongs to.

    ``merge`` has to be associative: merged parts are merged again. ``day_column`` is either
    a column of ``schema`` or the name under which the folders keep the UTC day of the
    instant ``day_of``.
    """

    schema: T.StructType
    merge: Callable[[DataFrame], DataFrame]
    day_column: str = "day"
    day_of: str | None = None
    output: str = ""

    def holds(self, part: Part) -> bool:
        return part.more.get("output", "") == self.output

    def stored_schema(self) -> T.StructType:
        if self.day_column in self.schema.names:
            return self.schema
        return T.StructType([*self.schema.fields, T.StructField(self.day_column, T.DateType())])


def write_parts(
    frame: DataFrame, path: str, kind: PartKind, reduce: Callable[[DataFrame], DataFrame]
) -> DataStreamWriter:
    """Writer that stores each reduced micro-batch and enters it under the stream's identity.

    A batch that is repeated after a restart was entered already or never: nothing counts
    twice, even if its parts were merged meanwhile. A stream with a fresh progress log has
    another identity and leaves earlier parts alone.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty(QUERY_ID)
        if not run:
            raise RuntimeError("the stream does not tell its identity")
        take_in(spark, path, kind, reduce(batch), run, batch_id)

    return event_time(frame).writeStream.foreachBatch(store)


def take_in(spark: SparkSession, path: str, kind: PartKind, rows: DataFrame, writer: str, batch_id: int) -> bool:
    """Store reduced rows as parts, unless this batch of this writer is in the log; whether they were entered."""
    return take_in_all(spark, path, [(kind, rows)], writer, batch_id)


def take_in_all(
    spark: SparkSession,
    path: str,
    outputs: Sequence[tuple[PartKind, DataFrame]],
    writer: str,
    batch_id: int,
    instead_of: Sequence[Part] = (),
) -> bool:
    """The same for several outputs of one batch: one entry, so readers see all of them or none.

    ``instead_of`` are parts that the batch was made from; they are retired by the same entry,
    and if another writer retired one of them first, nothing is entered.
    """
    log = CommitLog(spark, path)
    if log.newest().taken.get(writer, -1) >= batch_id:
        return False
    parts = tuple(part for kind, rows in outputs for part in _store(log, kind, rows, {}))
    retired, entered = tuple(instead_of), []

    def enter(entry: Entry) -> Entry | None:
        entered.clear()
        here = {part.path for part in entry.parts}
        if entry.taken.get(writer, -1) >= batch_id or not all(part.path in here for part in retired):
            return None
        entered.append(batch_id)
        return replace(entry.with_parts(parts, retired), taken={**entry.taken, writer: batch_id})

    log.commit(enter)
    return bool(entered)


def _store(log: CommitLog, kind: PartKind, rows: DataFrame, levels: dict[str | None, int]) -> tuple[Part, ...]:
    """Write rows by day into a new folder and describe its days; nothing counts before it is entered."""
    folder, day = f"part={uuid.uuid4().hex}", kind.day_column
    placed = rows.withColumn(day, local_day(rows, kind.day_of, "UTC")) if kind.day_of else rows
    placed.hint("rebalance", day).write.partitionBy(day).parquet(f"{log.root}/{folder}")
    return tuple(
        Part(f"{folder}/{name}", found, found, levels.get(found, 0), {"output": kind.output} if kind.output else {})
        for name in log.folders(folder)
        for found in [None if name.endswith(NO_DAY) else name.partition("=")[2]]
    )


def live_parts(
    spark: SparkSession, path: str, ranges: Sequence[DayRange] = (), kind: PartKind | None = None
) -> list[Part]:
    """The parts that count now, of all days or of some, of all kinds or of one."""
    bounds = [(lo and lo.isoformat(), hi and hi.isoformat()) for lo, hi in ranges] or [(None, None)]
    wanted = [part for part in CommitLog(spark, path).newest().parts if kind is None or kind.holds(part)]
    return [part for part in wanted if any(part.touches(*bound) for bound in bounds)]


def read_parts(spark: SparkSession, path: str, kind: PartKind, ranges: Sequence[DayRange] = ()) -> DataFrame:
    """The rows of the live parts, added up; empty before the first batch. Only the days asked for are opened."""
    rows = rows_of(spark, path, kind, live_parts(spark, path, ranges, kind))
    return kind.merge(rows.where(within_days(F.col(kind.day_column), ranges)).select(*kind.schema.names))


def rows_of(spark: SparkSession, path: str, kind: PartKind, parts: Sequence[Part]) -> DataFrame:
    """The rows of these parts as they are stored."""
    schema = kind.stored_schema()
    if not parts:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/{part.path}" for part in parts]
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).select(*schema.names)


def compact_parts(
    spark: SparkSession, path: str, kind: PartKind, fanout: int = FANOUT, closed: date | None = None
) -> list[str | None]:
    """Merge the parts of the days where that is due and return those days.

    Due is a level of a day with ``fanout`` parts or more, and every day up to ``closed`` that
    is in several parts. One entry puts the merged parts in and takes the old ones out: readers
    see either, and a compaction that dies before it leaves nothing but an unnamed folder.
    """
    log = CommitLog(spark, path)
    by_day: dict[str | None, list[Part]] = {}
    for part in log.newest().parts:
        if kind.holds(part):
            by_day.setdefault(part.low, []).append(part)
    due: dict[str | None, list[Part]] = {}
    for day, parts in by_day.items():
        if len(parts) > 1 and closed and day and day <= closed.isoformat():
            due[day] = parts
            continue
        for level in {part.level for part in parts}:
            same = [part for part in parts if part.level == level]
            if len(same) >= fanout:
                due.setdefault(day, []).extend(same)
    if not due:
        return []
    old = tuple(part for parts in due.values() for part in parts)
    levels = {day: max(part.level for part in parts) + 1 for day, parts in due.items()}
    merged = kind.merge(rows_of(spark, path, kind, old).select(*kind.schema.names))
    new = _store(log, kind, merged, levels)

    def swap(entry: Entry) -> Entry | None:
        here = {part.path for part in entry.parts}
        # Another compaction was faster: the parts this one merged are gone.
        return entry.with_parts(new, old) if all(part.path in here for part in old) else None

    entered = log.commit(swap)
    done = {part.path for part in entered.parts}
    return sorted(due, key=str) if all(part.path in done for part in new) else []


def vacuum_parts(spark: SparkSession, path: str) -> list[str]:
    """Remove retired and unnamed parts, once nobody reads or writes the store."""
    return CommitLog(spark, path).vacuum()
