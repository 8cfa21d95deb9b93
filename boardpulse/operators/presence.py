"""Which users were there on which day and page, as bitmaps that answer any period.

A bitmap stands for one day, page and bucket of 32,768 user ids. Users of a period are the OR
of its days, users who hold a position the AND with the holders' bitmap; admins are taken out
by counting the AND with theirs. The facts are read once, when a day is written; every later
count reads one small row per day, page and bucket.

The approximate form keeps one HyperLogLog sketch per day and page: a few kilobytes for any
number of users, merged over days, with a relative standard error of about
1.04 / sqrt(2 ** precision).

Ids are whole numbers; a null id is nobody, as in COUNT(DISTINCT).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardpulse.functions.calendar import DayRange, within_days
from boardpulse.functions.numbers import ratio
from boardpulse.operators.links import url_weights
from boardpulse.operators.scope import is_admin
from boardpulse.plans.params import ReportParams
from boardpulse.sources.feeds import seed_rows
from boardpulse.sources.tables import Tables

# Base-2 logarithm of the number of registers: 16,384 of them, an error of 0.8 %.
PRECISION = 14
DAY, PAGE = "session_date", "dashboard_url"

BITMAPS = T.StructType(
    [
        T.StructField(PAGE, T.StringType()),
        T.StructField("bucket", T.LongType()),
        T.StructField("users", T.BinaryType()),
        T.StructField(DAY, T.DateType()),
    ]
)
SKETCHES = T.StructType(
    [T.StructField(PAGE, T.StringType()), T.StructField("sketch", T.BinaryType()), T.StructField(DAY, T.DateType())]
)
PERIODS = T.StructType([T.StructField("name", T.StringType()), T.StructField("start", T.DateType()), T.StructField("end", T.DateType())])


def relative_error(precision: int = PRECISION) -> float:
    """The relative standard error of an estimate from sketches of that precision."""
    return 1.04 / 2 ** (precision / 2)


def bitmaps(frame: DataFrame, user_column: str, by: Sequence[str] = ()) -> DataFrame:
    """Users per ``by`` and bucket.

    A bucket of one group holds at most 32,768 users, so rows are first reduced to one per
    user and then shuffled as they are: a half-empty bitmap per task would be larger.
    """
    users = frame.where(F.col(user_column).isNotNull()).select(
        *by, F.bitmap_bucket_number(user_column).alias("bucket"), F.bitmap_bit_position(user_column).alias("bit")
    )
    placed = users.distinct().repartition(*by, "bucket")
    return placed.groupBy(*by, "bucket").agg(F.bitmap_construct_agg("bit").alias("users"))


def day_bitmaps(facts: DataFrame) -> DataFrame:
    return bitmaps(facts, "user_id", (DAY, PAGE))


def day_sketches(facts: DataFrame, precision: int = PRECISION) -> DataFrame:
    known = facts.where(F.col("user_id").isNotNull())
    return known.groupBy(DAY, PAGE).agg(F.hll_sketch_agg("user_id", precision).alias("sketch"))


def _write(frame: DataFrame, path: str) -> None:
    writer = frame.hint("rebalance", DAY).write.mode("overwrite").partitionBy(DAY)
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def write_presence(facts: DataFrame, path: str, precision: int = PRECISION) -> None:
    """Store bitmaps and sketches of the days supplied next to the facts; these days are replaced."""
    _write(day_bitmaps(facts), f"{path}/bitmaps")
    _write(day_sketches(facts, precision), f"{path}/sketches")


class Presence:
    """Counts of users over stored days, without the facts.

    The filters mean what they mean in a usage report: a position or a user restricts who
    counts, a dashboard which pages count, admins are left out on request.
    """

    def __init__(self, tables: Tables, days: DataFrame, sketches: DataFrame | None = None):
        self.tables, self.days, self.sketches = tables, days, sketches

    @classmethod
    def stored(cls, spark: SparkSession, tables: Tables, path: str) -> Presence:
        return cls(
            tables,
            spark.read.schema(BITMAPS).parquet(f"{path}/bitmaps"),
            spark.read.schema(SKETCHES).parquet(f"{path}/sketches"),
        )

    def _on_pages(self, days: DataFrame, dashboard_name: str | None) -> DataFrame:
        if dashboard_name is None:
            return days
        pages = url_weights(self.tables.dashboard_links, self.tables.dashboard_types, dashboard_name)
        return days.join(pages.where("weight > 0").select("_url"), F.col(PAGE) == F.col("_url"), "left_semi")

    def users_of(self, periods: DataFrame, params: ReportParams = ReportParams()) -> DataFrame:
        """Exact users of each of ``periods`` (name, start, end; null ends are open).

        Bitmaps of a day are merged over its pages first, then copied to the periods that
        hold the day; the periods are joined by day, so their number is no matter.
        """
        days = self._on_pages(self.days, params.dashboard_name).groupBy(DAY, "bucket").agg(F.bitmap_or_agg("users").alias("users"))
        # Periods meet days by equality: each is taken apart into its days, open ends at the store's.
        stored = self.days.agg(F.min(DAY).alias("low"), F.max(DAY).alias("high"))
        low, high = stored.select("low").scalar(), stored.select("high").scalar()
        bounded = periods.select("name", F.greatest("start", low).alias("_low"), F.least("end", high).alias("_high"))
        dates = bounded.where("_low <= _high").select("name", F.explode(F.sequence("_low", "_high")).alias("_day"))
        present = days.join(dates, F.col(DAY) == F.col("_day")).groupBy("name", "bucket").agg(F.bitmap_or_agg("users").alias("users"))
        if params.position_id is not None:
            held = self.tables.user_positions.where(F.col("position_id") == params.position_id)
            present = both(present, bitmaps(held, "user_id"))
        if params.user_id is not None:
            alone = seed_rows(self.tables.spark, [(params.user_id,)], T.StructType([T.StructField("user_id", T.LongType())]))
            present = both(present, bitmaps(alone, "user_id"))
        counted = present.select("name", F.bitmap_count("users").alias("n"))
        if params.exclude_admins:
            admins = self.tables.users.where(is_admin(F.col("role")))
            gone = both(present, bitmaps(admins, "id")).select("name", (-F.bitmap_count("users")).alias("n"))
            counted = counted.unionByName(gone)
        sums = counted.groupBy(F.col("name").alias("_name")).agg(F.sum("n").alias("n"))
        return (
            periods.select("name").join(sums, F.col("name").eqNullSafe(F.col("_name")), "left")
            .select("name", F.coalesce("n", F.lit(0)).alias("unique_users"))
        )

    def estimate(self, ranges: Sequence[DayRange], params: ReportParams = ReportParams()) -> DataFrame:
        """About how many users were there in any of ``ranges``, as ``unique_users``.

        Sketches cannot be intersected, so positions and single users need :meth:`users_of`.
        Admins are few: those who were there are counted exactly, from the buckets they are in.
        """
        if params.position_id is not None or params.user_id is not None:
            raise ValueError("sketches know no single users; count them exactly")
        wanted = within_days(F.col(DAY), ranges)
        merged = self._on_pages(self.sketches.where(wanted), params.dashboard_name).agg(
            F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n")
        )
        if params.exclude_admins:
            admins = bitmaps(self.tables.users.where(is_admin(F.col("role"))), "id")
            days = self._on_pages(self.days.where(wanted), params.dashboard_name)
            near = days.join(admins.select(F.col("bucket").alias("_bucket")), F.col("bucket") == F.col("_bucket"), "left_semi")
            present = near.groupBy("bucket").agg(F.bitmap_or_agg("users").alias("users"))
            there = both(present.select(F.lit("").alias("name"), "*"), admins)
            merged = merged.unionByName(there.select((-F.bitmap_count("users")).alias("n")))
        return merged.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(0)).alias("unique_users"))

    def adoption(self, as_of: date, reach: int, params: ReportParams = ReportParams(), exact: bool = True) -> DataFrame:
        """Active users since ``reach`` days before ``as_of`` against all users, as in the report."""
        since = as_of - timedelta(days=reach)
        everyone = ReportParams(exclude_admins=params.exclude_admins)
        if exact:
            period = seed_rows(self.tables.spark, [("active", since, None)], PERIODS)
            active = self.users_of(period, everyone).select("unique_users")
        else:
            active = self.estimate([(since, None)], everyone)
        counted = self.tables.users.agg(F.count("*").alias("total_users")).withColumn("active_users_30d", active.scalar())
        return counted.select(
            "total_users",
            "active_users_30d",
            ratio(F.col("active_users_30d"), F.col("total_users"), scale=100).alias("adoption_rate"),
            (F.col("total_users") - F.col("active_users_30d")).alias("inactive_users_count"),
        )


def both(present: DataFrame, others: DataFrame) -> DataFrame:
    """The users of each (name, bucket) of ``present`` who are also in the same bucket of ``others``."""
    theirs = others.select(F.col("bucket").alias("_bucket"), F.col("users").alias("_users"))
    met = present.join(theirs, F.col("bucket") == F.col("_bucket"))
    sides = met.select("name", "bucket", F.explode(F.array("users", "_users")).alias("users"))
    return sides.groupBy("name", "bucket").agg(F.bitmap_and_agg("users").alias("users"))
