"""Base KPIs of a whole table of requests, each with its own dates and filters, in one plan.

The bounds of all periods cut the days into elementary intervals. Facts are read once and
reduced to (user, page, interval); no request looks at them again. Sums come from three small
cubes of these rows (by interval alone, by position, by user asked for). A user counts in the
first interval of a period that shows him, so a fourth cube of intervals and the ones before
that showed the same users tells the unique users of any period. Equal questions are answered
once. The work after the reduction grows with the different questions and the intervals they
cover, neither with the facts nor with the users.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from boardpulse.functions.calendar import Period
from boardpulse.functions.numbers import ratio, variation
from boardpulse.operators.links import url_types, url_weights
from boardpulse.operators.scope import is_admin
from boardpulse.session import pin
from boardpulse.sources.tables import Tables

REQUESTS = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("start_date", T.DateType()),
        T.StructField("end_date", T.DateType()),
        T.StructField("position_id", T.LongType()),
        T.StructField("dashboard_name", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("exclude_admins", T.BooleanType()),
    ]
)
MEASURES = ("total_minutes", "total_sessions", "unique_users")


def base_kpis_of(tables: Tables, requests: DataFrame, as_of: date) -> DataFrame:
    """Per request the base KPIs of its period (``cur_``) and of the one before (``prev_``),
    averages and variations, as a report with these parameters has them.

    Request ids are unique. Absent dates and filters are null, as in ``ReportParams``. Jobs run
    while the plan is built: the requests and the reduced facts are pinned.
    """
    spans = pin(_spans(requests, as_of))
    return _assembled(requests, spans, _answers(tables, spans.select("span", "span.*").distinct()))


def _spans(requests: DataFrame, as_of: date) -> DataFrame:
    """Two rows per request: its period and the one before, with the question asked of it (``span``)."""
    end = F.coalesce("end_date", F.lit(as_of))
    start = F.coalesce(F.col("start_date"), F.date_sub(end, Period.DEFAULT_REACH))
    days = F.datediff("end", "start") + 1
    dated = requests.select(
        "request_id", "position_id", "dashboard_name", F.col("user_id").alias("asked_user"),
        F.coalesce("exclude_admins", F.lit(False)).alias("exclude_admins"), start.alias("start"), end.alias("end"),
    )
    periods = F.array(
        F.struct(F.lit("cur").alias("period"), F.col("start").alias("low"), F.col("end").alias("high")),
        F.struct(F.lit("prev").alias("period"), F.date_sub("start", days).alias("low"), F.date_sub("start", 1).alias("high")),
    )
    every = dated.withColumn("p", F.explode(periods)).select("*", "p.*").where("low <= high")
    asked = F.struct("low", "high", "position_id", "dashboard_name", "asked_user", "exclude_admins")
    return every.groupBy("request_id", "period", asked.alias("span")).agg(F.count("*").alias("copies"))


def _intervals(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Day to elementary interval, and span to the intervals it is made of; an interval is named by its first day."""
    cuts = spans.select(F.explode(F.array("low", F.date_add("high", 1))).alias("cut")).distinct()
    covered = spans.select("span", F.explode(F.sequence("low", "high")).alias("day"))
    # One row per day of the calendar that any request asks for: short, whatever the facts.
    days = covered.select("day").distinct().join(cuts, F.col("day") == F.col("cut"), "left")
    day_of = days.select("day", F.last("cut", ignorenulls=True).over(Window.orderBy("day")).alias("interval"))
    return day_of, covered.join(cuts, F.col("day") == F.col("cut")).select("span", F.col("cut").alias("interval"))


def _answers(tables: Tables, spans: DataFrame) -> DataFrame:
    day_of, parts = _intervals(spans)
    bounds = spans.agg(F.min("low"), F.max("high")).first()
    facts = tables.sessions((bounds[0], bounds[1])) if bounds[0] else tables.sessions((date(2000, 1, 2), date(2000, 1, 1)))
    reduced = pin(
        facts.join(day_of, F.col("session_date") == F.col("day"))
        .groupBy("user_id", "dashboard_url", "interval")
        .agg(F.count("*").alias("n"), F.sum("duration_minutes").alias("minutes"))
    )
    weighed = pin(_weighed(tables, reduced, spans.select("dashboard_name").distinct()))
    asked = parts.select("span", "interval", "span.*").drop("high")
    held = _held(tables, asked)
    answers = _sums(weighed, held, asked).unionByName(_users(weighed, held, asked))
    return answers.groupBy("span").agg(*[F.sum(name).alias(name) for name in ("n", "minutes", "users")])


def _weighed(tables: Tables, reduced: DataFrame, names: DataFrame) -> DataFrame:
    """(dashboard_name, user, interval): sessions and minutes with the weights of each dashboard asked for, null for all."""
    every = reduced.join(url_weights(tables.dashboard_links), F.col("dashboard_url") == F.col("_url"), "left")
    every = every.withColumn("weight", F.coalesce("weight", F.lit(1))).withColumn("dashboard_name", F.lit(None).cast("string"))
    types = tables.dashboard_types.select(F.col("id").alias("_type"), "name").join(
        names.select(F.col("dashboard_name").alias("_name")).where("_name IS NOT NULL"), F.col("name") == F.col("_name")
    )
    named = url_types(tables.dashboard_links).join(types, F.col("dashboard_type_id") == F.col("_type"))
    weights = named.groupBy("name", "url").agg(F.count("*").alias("weight"))
    some = reduced.join(weights, F.col("dashboard_url") == F.col("url")).withColumn("dashboard_name", F.col("name"))
    columns = ["dashboard_name", "user_id", "interval", "weight", "n", "minutes"]
    both = every.select(*columns).unionByName(some.select(*columns))
    admins = tables.users.where(is_admin(F.col("role"))).select(F.col("id").alias("_admin"))
    merged = both.groupBy("dashboard_name", "user_id", "interval").agg(
        F.sum(F.col("weight") * F.col("n")).alias("n"), F.sum(F.col("weight") * F.col("minutes")).alias("minutes")
    )
    # By the rules of NOT IN a null user is hidden as soon as there is an admin.
    hidden = F.col("_admin").isNotNull() | (F.col("user_id").isNull() & admins.exists())
    return merged.join(admins, F.col("user_id") == F.col("_admin"), "left").select(*merged.columns, hidden.alias("hidden"))


def _held(tables: Tables, asked: DataFrame) -> DataFrame:
    """Holders of the positions asked for."""
    held = tables.user_positions.select(F.col("user_id").alias("_holder"), F.col("position_id").alias("_position")).distinct()
    wanted = asked.select(F.col("position_id").alias("_wanted")).distinct()
    return held.join(wanted, F.col("_position") == F.col("_wanted"), "left_semi")


def _sums(weighed: DataFrame, held: DataFrame, asked: DataFrame) -> DataFrame:
    total = [F.sum("n").alias("n"), F.sum("minutes").alias("minutes")]
    by = ["dashboard_name", "hidden", "interval"]
    plain = weighed.groupBy(*by).agg(*total)
    placed = weighed.join(held, F.col("user_id") == F.col("_holder")).groupBy("_position", *by).agg(*total)
    people = asked.select(F.col("asked_user").alias("_asked")).distinct()
    single = weighed.join(people, F.col("user_id") == F.col("_asked"), "left_semi").withColumnRenamed("user_id", "_user")

    def met(requests: DataFrame, cube: DataFrame, key: Column | None) -> DataFrame:
        cube = cube.select(*[F.col(name).alias(f"c_{name}") for name in cube.columns])
        on = (F.col("interval") == F.col("c_interval")) & F.col("dashboard_name").eqNullSafe(F.col("c_dashboard_name"))
        rows = requests.join(cube, on if key is None else on & key)
        rows = rows.where(~(F.col("exclude_admins") & F.col("c_hidden"))).groupBy("span")
        return rows.agg(F.sum("c_n").alias("n"), F.sum("c_minutes").alias("minutes"), F.max((F.col("c_n") > 0).cast("long")).alias("users"))

    nobody, nowhere = F.col("asked_user").isNull(), F.col("position_id").isNull()
    here = held.select(F.col("_holder").alias("h_user"), F.col("_position").alias("h_position"))
    posted = asked.where(~nobody & ~nowhere).join(
        here, (F.col("asked_user") == F.col("h_user")) & (F.col("position_id") == F.col("h_position")), "left_semi"
    )
    of_user = asked.where(~nobody & nowhere).unionByName(posted)
    rows = met(asked.where(nobody & nowhere), plain, None)
    rows = rows.unionByName(met(asked.where(nobody & ~nowhere), placed, F.col("position_id") == F.col("c__position")))
    # A user asked for is one user or none; all others are counted apart.
    rows = rows.withColumn("users", F.lit(0).cast("long"))
    return rows.unionByName(met(of_user, single, F.col("asked_user") == F.col("c__user")))


def _users(weighed: DataFrame, held: DataFrame, asked: DataFrame) -> DataFrame:
    """Unique users of all questions that ask for no single one.

    A user's interval counts for the periods that begin after his interval before: numbers of
    users by interval and earliest such beginning (null: any), added up to where a period begins.
    """
    marks = weighed.where("n > 0 AND user_id IS NOT NULL").select("dashboard_name", "user_id", "interval", "hidden").distinct()
    before = F.lag("interval").over(Window.partitionBy("dashboard_name", "user_id").orderBy("interval"))
    marks = marks.withColumn("low", F.date_add(before, 1))
    by = ["position_id", "dashboard_name", "exclude_admins", "interval"]
    nowhere = marks.withColumn("position_id", F.lit(None).cast("long"))
    placed = marks.join(held, F.col("user_id") == F.col("_holder")).withColumn("position_id", F.col("_position"))
    cube = nowhere.unionByName(placed.select(*nowhere.columns)).groupBy("position_id", "dashboard_name", "interval", "low", "hidden")
    both = F.explode(F.when(F.col("hidden"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))
    steps = cube.agg(F.count("*").alias("here")).withColumn("exclude_admins", both)
    nothing = F.lit(None).cast(asked.schema["span"].dataType)
    points = asked.where("asked_user IS NULL").select("span", *by, "low", F.lit(0).cast("long").alias("here"))
    rows = points.unionByName(steps.select(nothing.alias("span"), *by, "low", "here"))
    # All rows of a window have one interval: at most as many as there are pairs of days around it.
    reached = Window.partitionBy(*by).orderBy("low").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.withColumn("users", F.sum("here").over(reached)).where("span IS NOT NULL AND users > 0")
    zero = F.lit(0).cast("long")
    return met.select("span", zero.alias("n"), zero.alias("minutes"), "users")


def _assembled(requests: DataFrame, spans: DataFrame, answers: DataFrame) -> DataFrame:
    columns = []
    for period in ("cur", "prev"):
        there = F.col("period") == period
        for name, measure in zip(MEASURES, ("minutes", "n", "users")):
            columns.append(F.coalesce(F.sum(F.when(there, F.col(measure))), F.lit(0)).alias(f"{period}_{name}"))
    # Ids are unique; sessions and minutes of one that is repeated are met by each row and each period of it.
    times = F.col("copies") * F.col("copies")
    met = spans.join(answers, "span").withColumns({"n": F.col("n") * times, "minutes": F.col("minutes") * times})
    summed = met.groupBy(F.col("request_id").alias("_id")).agg(*columns)
    names = [f"{period}_{name}" for period in ("cur", "prev") for name in MEASURES]
    full = requests.select("request_id").join(summed, F.col("request_id") == F.col("_id"), "left")
    full = full.select("request_id", *[F.coalesce(name, F.lit(0)).alias(name) for name in names])
    return full.select(
        "*",
        ratio(F.col("cur_total_sessions"), F.col("cur_unique_users")).alias("avg_sessions_user"),
        ratio(F.col("cur_total_minutes"), F.col("cur_total_sessions")).alias("avg_time_session"),
        variation(F.col("cur_unique_users"), F.col("prev_unique_users")).alias("var_users"),
        variation(F.col("cur_total_sessions"), F.col("prev_total_sessions")).alias("var_sessions"),
        variation(F.col("cur_total_minutes"), F.col("prev_total_minutes")).alias("var_time"),
    )
