"""Removing users from stored facts by opening only the days they were there.

The day bitmaps kept next to the facts are the index from user to days: a day is touched if
its bitmaps and that of the doomed users have a bit in common. Touched days are written again,
first the facts and then the bitmaps, so a job that dies in between finds them again; files of
other days keep their names.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardpulse.operators.presence import BITMAPS, DAY, bitmaps, both, write_presence
from boardpulse.operators.removal import without
from boardpulse.sources.tables import write_sessions


def touched_days(days: DataFrame, doomed: DataFrame) -> list[date]:
    """Days of bitmaps ``days`` on which anyone in the first column of ``doomed`` was there."""
    # Buckets without a doomed user leave before the bitmaps of a day are merged.
    wanted = bitmaps(doomed, doomed.columns[0])
    near = days.join(wanted.select(F.col("bucket").alias("_near")), F.col("bucket") == F.col("_near"), "left_semi")
    present = near.groupBy(F.col(DAY).alias("name"), "bucket").agg(F.bitmap_or_agg("users").alias("users"))
    met = both(present, wanted).where(F.bitmap_count("users") > 0)
    return sorted(row["name"] for row in met.select("name").distinct().collect())


def purge_stored_facts(
    spark: SparkSession, facts: str, presence: str, schema: T.StructType, doomed: DataFrame
) -> list[date]:
    """Take the facts of ``doomed`` users out of the store and return the days that were written again.

    A day that held nobody else goes altogether. Null users and facts without a day stay.
    """
    kept = spark.read.schema(BITMAPS).parquet(f"{presence}/bitmaps")
    days = touched_days(kept, doomed)
    if not days:
        return []
    stored = spark.read.schema(schema).parquet(facts)
    write_sessions(without(stored.where(F.col(DAY).isin(days)), "user_id", doomed), facts)
    # Where nobody else was, nothing was written and so nothing replaced: these days go as a whole.
    now = without(spark.read.schema(schema).parquet(facts).where(F.col(DAY).isin(days)), "user_id", doomed)
    left = sorted(row[DAY] for row in now.select(DAY).distinct().collect())
    emptied = [day for day in days if day not in left]
    for day in emptied:
        _remove(spark, f"{facts}/{DAY}={day}")
    if left:
        write_presence(spark.read.schema(schema).parquet(facts).where(F.col(DAY).isin(left)), presence)
    for day in emptied:
        for name in ("bitmaps", "sketches"):
            _remove(spark, f"{presence}/{name}/{DAY}={day}")
    return days


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
