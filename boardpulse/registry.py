"""Named queries over the generic test tables, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardpulse.functions.calendar import LOCAL_ZONE, Period, preset_bounds
from boardpulse.operators import changes, integrity, removal
from boardpulse.operators.presence import PERIODS, Presence, relative_error, write_presence
from boardpulse.operators.stored_purge import purge_stored_facts
from boardpulse.plans import access, audit, directory
from boardpulse.plans.params import ReportParams
from boardpulse.plans.periods import period_overview
from boardpulse.plans.report import ACTIVE_DAYS, UsageReport
from boardpulse.plans.requests import base_kpis_of
from boardpulse.sources import testbed
from boardpulse.sources.feeds import seed_rows, split_by_required
from boardpulse.session import pin, run_dir
from boardpulse.sources.sinks import write_rows
from boardpulse.sources.tables import Tables, drop_legacy_columns, from_frame, write_sessions
from boardpulse.sources.zones import Zone, read_zones, write_zoned_sessions
from boardpulse.streaming import engagement, intake, ratewatch, rollup
from boardpulse.streaming.runner import drain_partials, drain_parts

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = date(2024, 1, 30)
START, END = date(2024, 1, 27), date(2024, 1, 29)
POSITION, USER, DASHBOARD = 7, 7, "Ventas"
BREACH_WINDOW, BREACH_LIMIT, LOGIN_LIMIT = "1 day", 4, 1
GAP_SECONDS = 6 * 3600
STREAM_FILES = 3

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def doubles(frame: DataFrame) -> DataFrame:
    """Exact decimals as plain doubles."""
    return frame.select(
        *[
            F.col(name).cast("double").alias(name) if kind.startswith("decimal") else F.col(name)
            for name, kind in frame.dtypes
        ]
    )


def report(spark: SparkSession, sf_dir: str, **filters) -> UsageReport:
    params = ReportParams(start_date=START, end_date=END, **filters)
    return UsageReport(testbed.tables(spark, sf_dir), params, AS_OF)


# -- report --------------------------------------------------------------------------


@query
def period_bounds(spark, sf_dir):
    presets = {name: preset_bounds(name, AS_OF) for name in ("reset", "this_month", "30d")}
    periods = {name: Period.resolve(*bounds, AS_OF) for name, bounds in presets.items()}
    periods["custom"] = Period(START, END)
    return period_overview(testbed.tables(spark, sf_dir), periods)


@query
def base_kpis(spark, sf_dir):
    return report(spark, sf_dir).base_kpis()


@query
def base_kpis_by_position(spark, sf_dir):
    return report(spark, sf_dir, position_id=POSITION).base_kpis()


@query
def base_kpis_by_dashboard(spark, sf_dir):
    return report(spark, sf_dir, dashboard_name=DASHBOARD).base_kpis()


@query
def base_kpis_by_user(spark, sf_dir):
    return report(spark, sf_dir, user_id=USER).base_kpis()


@query
def base_kpis_no_admins(spark, sf_dir):
    return report(spark, sf_dir, exclude_admins=True).base_kpis()


@query
def base_kpis_previous(spark, sf_dir):
    return report(spark, sf_dir).base_kpis_previous()


@query
def adoption(spark, sf_dir):
    return doubles(report(spark, sf_dir).adoption())


@query
def adoption_no_admins(spark, sf_dir):
    return doubles(report(spark, sf_dir, exclude_admins=True).adoption())


@query
def usage_averages(spark, sf_dir):
    return doubles(report(spark, sf_dir).averages())


@query
def usage_variation(spark, sf_dir):
    return report(spark, sf_dir).variations()


@query
def top_dashboard(spark, sf_dir):
    return report(spark, sf_dir).top_dashboard()


@query
def sessions_over_time(spark, sf_dir):
    return report(spark, sf_dir).over_time()


@query
def sessions_by_dashboard(spark, sf_dir):
    return report(spark, sf_dir).by_dashboard()


@query
def sessions_by_dashboard_no_admins(spark, sf_dir):
    return report(spark, sf_dir, exclude_admins=True).by_dashboard()


@query
def sessions_by_position(spark, sf_dir):
    return report(spark, sf_dir).by_position()


@query
def engagement_histogram(spark, sf_dir):
    return report(spark, sf_dir).engagement_shares()


@query
def top_users(spark, sf_dir):
    return report(spark, sf_dir).top_users()


@query
def report_kpis(spark, sf_dir):
    kpis = report(spark, sf_dir, position_id=POSITION, exclude_admins=True).kpis()
    top = F.col("top_dashboard")
    flat = kpis.withColumns({"top_name": top["name"], "top_count": top["count"]})
    return doubles(flat.drop("top_dashboard"))


@query
def report_kpis_from_text(spark, sf_dir):
    """The KPIs of a report asked for in query-string form."""
    asked = {"from": START.isoformat(), "to": END.isoformat(), "positionId": str(POSITION), "userId": "", "exclude_admins": "true"}
    kpis = UsageReport(testbed.tables(spark, sf_dir), ReportParams.from_query(asked), AS_OF).kpis()
    top = F.col("top_dashboard")
    return doubles(kpis.withColumns({"top_name": top["name"], "top_count": top["count"]}).drop("top_dashboard"))


@query
def position_rows_written(spark, sf_dir):
    """A section written as a row set and read back."""
    rows = report(spark, sf_dir).by_position()
    folder = run_dir(spark, "rows")
    write_rows(rows, folder, "json")
    return spark.read.schema(rows.schema).json(folder)


@query
def report_document(spark, sf_dir):
    return report(spark, sf_dir).document()


@query
def kpi_cards(spark, sf_dir):
    return report(spark, sf_dir).cards()


# -- users of any period, from what is kept next to the facts ---------------------------------


def presence(spark: SparkSession, sf_dir: str) -> Presence:
    """Bitmaps and sketches of all days, stored and read back."""
    tables = testbed.tables(spark, sf_dir)
    folder = run_dir(spark, "presence")
    write_presence(tables.sessions(), folder)
    return Presence.stored(spark, tables, folder)


@query
def unique_users_of_periods(spark, sf_dir):
    """Unique users of the period and the one before under each filter and under all."""
    kept = presence(spark, sf_dir)
    now, before = Period(START, END), Period(START, END).previous()
    periods = seed_rows(spark, [("now", now.start, now.end), ("before", before.start, before.end)], PERIODS)
    filters = {
        "none": {},
        "position": {"position_id": POSITION},
        "dashboard": {"dashboard_name": DASHBOARD},
        "user": {"user_id": USER},
        "no_admins": {"exclude_admins": True},
        "all": {"position_id": POSITION, "dashboard_name": DASHBOARD, "exclude_admins": True},
    }
    frames = [
        kept.users_of(periods, ReportParams(**chosen)).select(F.lit(name).alias("filter"), F.col("name").alias("period"), "unique_users")
        for name, chosen in filters.items()
    ]
    every = frames[0]
    for frame in frames[1:]:
        every = every.unionByName(frame)
    return every


@query
def active_users_by_day(spark, sf_dir):
    """Users of the thirty days up to each day, without admins."""
    kept = presence(spark, sf_dir)
    days = kept.days.select(F.col("session_date").alias("day")).distinct()
    periods = days.select(F.col("day").cast("string").alias("name"), F.date_sub("day", ACTIVE_DAYS).alias("start"), F.col("day").alias("end"))
    users = kept.users_of(periods, ReportParams(exclude_admins=True))
    return users.select(F.col("name").cast("date").alias("day"), F.col("unique_users").alias("active_users"))


@query
def adoption_from_bitmaps(spark, sf_dir):
    return doubles(presence(spark, sf_dir).adoption(AS_OF, ACTIVE_DAYS))


@query
def adoption_from_bitmaps_no_admins(spark, sf_dir):
    return doubles(presence(spark, sf_dir).adoption(AS_OF, ACTIVE_DAYS, ReportParams(exclude_admins=True)))


@query
def active_users_estimated(spark, sf_dir):
    """Exact active users, and whether the estimates stay within three standard errors."""
    kept = presence(spark, sf_dir)
    since = AS_OF - timedelta(days=ACTIVE_DAYS)
    period = seed_rows(spark, [("active", since, None)], PERIODS)
    counts = None
    for admins in (True, False):
        params = ReportParams(exclude_admins=not admins)
        exact = kept.users_of(period, params).select(F.lit(admins).alias("with_admins"), "unique_users", F.lit(0).alias("about"))
        about = kept.estimate([(since, None)], params).select(F.lit(admins).alias("with_admins"), F.lit(0).alias("unique_users"), F.col("unique_users").alias("about"))
        both = exact.unionByName(about)
        counts = both if counts is None else counts.unionByName(both)
    counts = counts.groupBy("with_admins").agg(F.sum("unique_users").alias("active_users"), F.sum("about").alias("about"))
    near = F.abs(F.col("about") - F.col("active_users")) <= 3 * relative_error() * F.col("active_users")
    return counts.select("with_admins", "active_users", near.alias("near"))


def request_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per customer: dates, position, dashboard, user and admins as the numbers of the customer say."""
    key = F.col("c_custkey")
    start = F.date_add(F.lit(date(2024, 1, 1)), (key % 29).cast("int"))
    return testbed.read(spark, sf_dir, "customer").select(
        key.cast("long").alias("request_id"),
        F.when(key % 10 != 0, start).alias("start_date"),
        F.when(key % 8 != 0, F.date_add(start, (key % 9).cast("int"))).alias("end_date"),
        F.when(key % 3 == 0, F.col("c_nationkey")).cast("long").alias("position_id"),
        F.when(key % 5 == 0, "Ventas").when(key % 5 == 1, "Stock").when(key % 5 == 2, "Nada").alias("dashboard_name"),
        F.when(key % 7 == 0, F.floor(key / 7)).cast("long").alias("user_id"),
        (key % 2 == 0).alias("exclude_admins"),
    )


@query
def base_kpis_of_requests(spark, sf_dir):
    """Base KPIs of as many requests as there are customers, each with filters of its own."""
    return doubles(base_kpis_of(testbed.tables(spark, sf_dir), request_table(spark, sf_dir), AS_OF))


# -- audit log ---------------------------------------------------------------------------


@query
def audit_log(spark, sf_dir):
    return audit.audit_log(testbed.tables(spark, sf_dir))


@query
def audit_log_filtered(spark, sf_dir):
    return audit.audit_log(
        testbed.tables(spark, sf_dir), START, END, position_id=POSITION, dashboard_name=DASHBOARD
    )


@query
def audit_log_of_user(spark, sf_dir):
    return audit.audit_log(testbed.tables(spark, sf_dir), START, None, user_id=USER)


@query
def recent_activity(spark, sf_dir):
    return audit.recent_activity(audit.audit_log(testbed.tables(spark, sf_dir), START, END))


def zoned(spark: SparkSession, sf_dir: str) -> tuple[Tables, list[Zone] | None]:
    """Facts stored by day, and the zones of these days."""
    tables = testbed.tables(spark, sf_dir)
    folder = run_dir(spark, "zoned")
    sessions = tables.sessions()
    write_zoned_sessions(sessions, f"{folder}/facts", f"{folder}/zones")
    stored = spark.read.schema(sessions.schema).parquet(f"{folder}/facts")
    return tables.with_sessions(stored), read_zones(spark, f"{folder}/facts", f"{folder}/zones")


@query
def audit_log_newest_days(spark, sf_dir):
    """The log from stored facts, of which only the newest days are opened."""
    tables, zones = zoned(spark, sf_dir)
    return audit.audit_log(tables, zones=zones)


@query
def audit_log_of_user_newest_days(spark, sf_dir):
    tables, zones = zoned(spark, sf_dir)
    return audit.audit_log(tables, START, None, user_id=USER, zones=zones)


# -- entitlements -----------------------------------------------------------------------------


@query
def user_profiles(spark, sf_dir):
    profiles = access.user_profiles(testbed.tables(spark, sf_dir))
    return profiles.withColumn("positions", F.to_json("positions"))


@query
def metrics_viewers(spark, sf_dir):
    return access.metrics_viewers(testbed.tables(spark, sf_dir))


@query
def user_dashboards(spark, sf_dir):
    return access.user_dashboards(testbed.tables(spark, sf_dir))


@query
def user_directory(spark, sf_dir):
    directory = access.user_directory(testbed.tables(spark, sf_dir))
    ids = F.array_join(F.col("position_ids").cast("array<string>"), ",")
    return directory.withColumns({"positions": F.to_json("positions"), "position_ids": ids})


@query
def link_matrix(spark, sf_dir):
    return access.link_matrix(testbed.tables(spark, sf_dir))


@query
def position_catalog(spark, sf_dir):
    return access.position_catalog(testbed.tables(spark, sf_dir))


@query
def type_catalog(spark, sf_dir):
    return access.type_catalog(testbed.tables(spark, sf_dir))


@query
def links_of_types(spark, sf_dir):
    """Types with the number of links that would go with each of them."""
    tables = testbed.tables(spark, sf_dir)
    links = tables.dashboard_links.groupBy(F.col("dashboard_type_id").alias("_type")).agg(
        F.count("*").alias("_links")
    )
    named = tables.dashboard_types.join(links, F.col("id") == F.col("_type"), "left")
    return named.select("id", "name", F.coalesce("_links", F.lit(0)).alias("links"))


@query
def users_of_position(spark, sf_dir):
    return access.users_of_position(testbed.tables(spark, sf_dir), POSITION)


@query
def types_of_position(spark, sf_dir):
    return access.types_of_position(testbed.tables(spark, sf_dir), POSITION)


# -- feeds -----------------------------------------------------------------------------------------


def activity(events: DataFrame) -> DataFrame:
    """Events as on-page activity; being on the login page is being on no dashboard."""
    page = F.when(F.col("event_type") != "signup", testbed.page_url())
    return events.select("user_id", page.alias("dashboard_url"), "ts")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of several batches: dealt into files, one file at a time."""
    events = testbed.read(spark, sf_dir, "events")
    folder = run_dir(spark, "event-files")
    events.repartition(STREAM_FILES, F.xxhash64("event_id")).write.parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testbed.pings(spark, sf_dir).where(F.col("dashboard_url") == rollup.LOGIN_PORTAL)


@query
def session_rollup(spark, sf_dir):
    return rollup.dashboard_sessions(testbed.pings(spark, sf_dir))


@query
def login_rollup(spark, sf_dir):
    return rollup.login_markers(logins(spark, sf_dir))


@query
def engaged_ticks(spark, sf_dir):
    return engagement.engaged_ticks(activity(testbed.read(spark, sf_dir, "events")))


@query
def engaged_sessions(spark, sf_dir):
    return engagement.engaged_sessions(activity(testbed.read(spark, sf_dir, "events")))


@query
def idle_sessions(spark, sf_dir):
    return engagement.idle_sessions(activity(testbed.read(spark, sf_dir, "events")), GAP_SECONDS)


@query
def idle_sessions_five_minutes(spark, sf_dir):
    return engagement.idle_sessions(activity(testbed.read(spark, sf_dir, "events")))


@query
def rate_breaches(spark, sf_dir):
    return ratewatch.rate_breaches(testbed.access_log(spark, sf_dir), BREACH_LIMIT, BREACH_WINDOW)


@query
def login_breaches(spark, sf_dir):
    return ratewatch.rate_breaches(logins(spark, sf_dir), LOGIN_LIMIT, BREACH_WINDOW, key="user_id")


@query
def session_rollup_stream(spark, sf_dir):
    return drain_partials(testbed.as_pings(event_stream(spark, sf_dir)), "sessions", LOCAL_ZONE)


@query
def closed_day_sessions_stream(spark, sf_dir):
    """Sessions of the days that are over, after their parts were merged and retired."""
    pings = testbed.as_pings(event_stream(spark, sf_dir))

    def read(path: str) -> DataFrame:
        rollup.compact_partials(spark, path, closed=AS_OF, with_id=True)
        return rollup.read_partials(spark, path, [(None, AS_OF)])

    return drain_parts(spark, "closing", lambda path: rollup.write_partials(pings, path), read)


@query
def engaged_ticks_stream(spark, sf_dir):
    pages = activity(event_stream(spark, sf_dir))
    return drain_parts(
        spark, "ticks", lambda path: engagement.write_ticks(pages, path), lambda path: engagement.read_ticks(spark, path)
    )


@query
def idle_sessions_stream(spark, sf_dir):
    pages = activity(event_stream(spark, sf_dir))
    return drain_parts(
        spark,
        "idle",
        lambda path: engagement.write_idle_sessions(pages, path, GAP_SECONDS),
        lambda path: engagement.read_idle_sessions(spark, path, GAP_SECONDS),
    )


@query
def rate_breaches_stream(spark, sf_dir):
    requests = event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), "ts")
    return drain_parts(
        spark,
        "breaches",
        lambda path: ratewatch.write_counts(requests, path, BREACH_WINDOW),
        lambda path: ratewatch.read_breaches(spark, path, BREACH_LIMIT),
    )


def blank_pages(events: DataFrame) -> DataFrame:
    """Pings of which one kind names no page, by null or by an empty text."""
    none = F.when(F.col("event_id") % 2 == 0, F.lit(""))
    page = F.when(F.col("event_type") != "error", testbed.page_url()).otherwise(none)
    return events.select(F.col("event_id").alias("id"), "user_id", page.alias("dashboard_url"), "ts")


@query
def blank_pings_refused(spark, sf_dir):
    return rollup.dashboard_sessions(blank_pages(testbed.read(spark, sf_dir, "events")))


@query
def blank_pings_refused_stream(spark, sf_dir):
    return drain_partials(blank_pages(event_stream(spark, sf_dir)), "blanks", LOCAL_ZONE)


def ping_lines(events: DataFrame) -> DataFrame:
    """Events as raw JSON lines of which some are cut off, name nobody, or name no page."""
    ping = F.to_json(
        F.struct(
            F.when(F.col("event_id") % 17 != 0, F.col("user_id")).alias("user_id"),
            F.when(F.col("event_id") % 13 != 0, testbed.page_url()).otherwise(F.lit("")).alias("dashboard_url"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"),
        )
    )
    return events.select(F.when(F.col("event_id") % 19 == 0, F.substring(ping, 1, 20)).otherwise(ping).alias("value"))


def line_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_dir(spark, "ping-lines")
    ping_lines(testbed.read(spark, sf_dir, "events")).repartition(STREAM_FILES).write.text(folder)
    return spark.readStream.option("maxFilesPerTrigger", 1).text(folder)


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Lines by what became of them."""
    accepted = intake.read_accepted(spark, path).agg(F.coalesce(F.sum("pings"), F.lit(0)).alias("lines"))
    refused = intake.read_refused(spark, path).groupBy(F.col("reason").alias("outcome")).agg(F.count("*").alias("lines"))
    return accepted.select(F.lit("accepted").alias("outcome"), "lines").unionByName(refused)


@query
def ping_line_outcomes_stream(spark, sf_dir):
    lines = line_stream(spark, sf_dir)
    return drain_parts(spark, "intake", lambda path: intake.write_intake(lines, path), lambda path: outcomes(spark, path))


@query
def replayed_pings_stream(spark, sf_dir):
    """Sessions after the lines without a page were mended and taken in again, and after compaction."""
    lines = line_stream(spark, sf_dir)

    def mend(letters: DataFrame) -> DataFrame:
        named = F.regexp_replace("line", '"dashboard_url":""', f'"dashboard_url":"{testbed.URL_ROOT}lost"')
        return letters.withColumn("line", F.when(F.col("reason") == intake.NO_PAGE, named).otherwise(F.col("line")))

    def read(path: str) -> DataFrame:
        intake.replay_refused(spark, path, mend, "pages")
        intake.replay_refused(spark, path, mend, "pages")
        intake.compact_intake(spark, path, closed=AS_OF)
        return intake.read_accepted(spark, path)

    return drain_parts(spark, "replay", lambda path: intake.write_intake(lines, path), read)


@query
def stored_sessions_report(spark, sf_dir):
    """Sessions per day of facts stored by day, after one day was written again with fewer rows."""
    sessions = testbed.tables(spark, sf_dir).sessions()
    folder = run_dir(spark, "stored-sessions")
    write_sessions(sessions, folder)
    write_sessions(sessions.where((F.col("session_date") == F.lit(START)) & (F.col("user_id") % 2 == 0)), folder)
    stored = from_frame(spark.read.schema(sessions.schema).parquet(folder))
    days = stored([(START, END)]).groupBy("session_date")
    return days.agg(F.count("id").alias("sessions"), F.sum("duration_minutes").alias("minutes"))


@query
def audit_log_complete(spark, sf_dir):
    """The whole log of one position, with no limit before the filter."""
    return audit.audit_log(testbed.tables(spark, sf_dir), position_id=POSITION, limit=None)


# -- table upkeep ------------------------------------------------------------------------------------


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = testbed.read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name"
    )
    return testbed.read(spark, sf_dir, "customer").join(nations, "c_nationkey")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testbed.users(testbed.read(spark, sf_dir, "customer"))


def position_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer sets the flag of their nation (known) and of their segment (new)."""
    return customers(spark, sf_dir).select(
        F.explode(F.array("n_name", "c_mktsegment")).alias("name"),
        (F.col("c_acctbal") > 0).alias("can_view_metrics"),
        F.col("c_custkey").alias("seq"),
    )


def upserted_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.upsert(
        testbed.positions(testbed.read(spark, sf_dir, "nation")), position_changes(spark, sf_dir), ["name"], ["seq"], "id"
    )


def overdrawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testbed.read(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0)


@query
def upsert_positions(spark, sf_dir):
    return upserted_positions(spark, sf_dir)


@query
def upsert_users(spark, sf_dir):
    """Suppliers are new; customers in debt become admins and keep their address."""
    added = testbed.read(spark, sf_dir, "supplier").select(
        F.lower("s_name").alias("username"), F.col("s_name").alias("name"), F.lit("user").alias("role")
    )
    changed = overdrawn(spark, sf_dir).select(
        F.lower("c_name").alias("username"), F.col("c_name").alias("name"), F.lit("admin").alias("role")
    )
    return changes.upsert(
        users(spark, sf_dir), added.unionByName(changed), ["username"], id_column="id"
    )


@query
def update_users(spark, sf_dir):
    """A new address for known users; unknown ones are not added."""
    moved = overdrawn(spark, sf_dir).select(
        F.lower("c_name").alias("username"), F.concat(F.lower("c_name"), F.lit("@new.example")).alias("email")
    )
    unknown = testbed.read(spark, sf_dir, "supplier").select(
        F.lower("s_name").alias("username"), F.lit("nobody@new.example").alias("email")
    )
    latest = changes.latest_changes(moved.unionByName(unknown), ["username"], [])
    return changes.update_by_key(users(spark, sf_dir), latest, ["username"])


def assignment(spark: SparkSession, sf_dir: str) -> changes.Assignment:
    """Customers ask for the position of their nation, some by a name nobody knows."""
    asked = F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")).when(
        F.col("c_mktsegment") != "BUILDING", F.col("n_name")
    )
    known = customers(spark, sf_dir).select(
        F.lower("c_name").alias("username"), asked.alias("position_name")
    )
    strangers = testbed.read(spark, sf_dir, "supplier").select(
        F.lower("s_name").alias("username"),
        F.concat(F.lit("NATION_"), F.col("s_nationkey")).alias("position_name"),
    )
    tables = testbed.tables(spark, sf_dir)
    return changes.assign_by_name(
        tables.user_positions, tables.users, tables.positions, known.unionByName(strangers)
    )


@query
def assign_positions(spark, sf_dir):
    return assignment(spark, sf_dir).user_positions


@query
def assign_positions_unresolved(spark, sf_dir):
    return assignment(spark, sf_dir).unresolved


@query
def replace_assignments(spark, sf_dir):
    """Customers in debt get two positions, those of one segment lose all of theirs."""
    home = F.col("c_nationkey").cast("long")
    given = F.when(F.col("c_acctbal") < 0, F.array(home, (home + 1) % 25)).otherwise(
        F.array(F.lit(None).cast("long"))
    )
    asked = (
        testbed.read(spark, sf_dir, "customer")
        .where((F.col("c_acctbal") < 0) | (F.col("c_mktsegment") == "BUILDING"))
        .select(F.col("c_custkey").alias("user_id"), F.explode(given).alias("position_id"))
    )
    return changes.replace_assignments(testbed.user_positions(testbed.read(spark, sf_dir, "customer")), asked)


def loaded(spark: SparkSession, sf_dir: str) -> directory.Loaded:
    """Segments become positions, suppliers become users who ask for the one of their nation."""
    segments = testbed.read(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("name"), F.lit(None).cast("boolean").alias("can_view_metrics")
    )
    people = testbed.read(spark, sf_dir, "supplier").select(
        F.lower("s_name").alias("username"),
        F.col("s_name").alias("name"),
        F.lit("user").alias("role"),
        F.when(F.col("s_acctbal") > 0, F.concat(F.lit("NATION_"), F.col("s_nationkey")))
        .otherwise("NOWHERE")
        .alias("position_name"),
    )
    return directory.load_directory(
        testbed.tables(spark, sf_dir), directory.clean_positions(segments), people
    )


@query
def load_directory(spark, sf_dir):
    """Who holds what after the load, by name."""
    return access.user_profiles(loaded(spark, sf_dir).tables).select("id", "username", "position_name")


@query
def load_directory_unresolved(spark, sf_dir):
    return loaded(spark, sf_dir).rejected.select("username", "position_name")


def enrolled(spark: SparkSession, sf_dir: str) -> directory.Loaded:
    """All suppliers and customers ask to be users; only the former are new and complete."""
    nation = F.col("s_nationkey").cast("long")
    strangers = testbed.read(spark, sf_dir, "supplier").select(
        F.lower("s_name").alias("username"),
        F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("name"),
        F.lit("").alias("email"),
        F.lit("user").alias("role"),
        F.array(nation, (nation + 1) % 25).alias("position_ids"),
    )
    known = users(spark, sf_dir).select(
        "username", "name", "email", "role", F.lit(None).cast("array<long>").alias("position_ids")
    )
    return directory.enroll_users(testbed.tables(spark, sf_dir), strangers.unionByName(known))


@query
def enroll_users(spark, sf_dir):
    return enrolled(spark, sf_dir).tables.users


@query
def enroll_users_positions(spark, sf_dir):
    return enrolled(spark, sf_dir).tables.user_positions


@query
def enroll_users_rejected(spark, sf_dir):
    return enrolled(spark, sf_dir).rejected


def revised(spark: SparkSession, sf_dir: str) -> directory.Loaded:
    """Customers in debt lose their address and move; as many ids beyond the last are unknown."""
    home = F.col("c_nationkey").cast("long")
    wanted = overdrawn(spark, sf_dir).select(
        F.explode(F.array(F.col("c_custkey"), -1 - F.col("c_custkey"))).alias("id"),
        F.lower("c_name").alias("username"),
        F.upper("c_name").alias("name"),
        F.lit("").alias("email"),
        F.lit("user").alias("role"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.array().cast("array<long>"))
        .otherwise(F.array((home + 1) % 25, (home + 1) % 25))
        .alias("position_ids"),
    )
    return directory.revise_users(testbed.tables(spark, sf_dir), wanted)


@query
def revise_users(spark, sf_dir):
    return revised(spark, sf_dir).tables.users


@query
def revise_users_positions(spark, sf_dir):
    return revised(spark, sf_dir).tables.user_positions


@query
def revise_users_unknown(spark, sf_dir):
    return revised(spark, sf_dir).rejected


def purged(spark: SparkSession, sf_dir: str) -> Tables:
    return removal.purge_users(
        testbed.tables(spark, sf_dir), overdrawn(spark, sf_dir).select("c_custkey")
    )


@query
def purge_users(spark, sf_dir):
    return purged(spark, sf_dir).users


@query
def purge_users_stored_sessions(spark, sf_dir):
    """Stored facts after indebted users were taken out, from the days they were there."""
    folder, sessions = run_dir(spark, "purged"), testbed.tables(spark, sf_dir).sessions()
    write_sessions(sessions, f"{folder}/facts")
    write_presence(sessions, f"{folder}/presence")
    purge_stored_facts(spark, f"{folder}/facts", f"{folder}/presence", sessions.schema, overdrawn(spark, sf_dir).select("c_custkey"))
    return spark.read.schema(sessions.schema).parquet(f"{folder}/facts")


@query
def purge_users_positions(spark, sf_dir):
    return purged(spark, sf_dir).user_positions


@query
def purge_users_sessions(spark, sf_dir):
    return purged(spark, sf_dir).sessions()


def without_top_type(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables after the most used dashboard type is taken out."""
    usage = report(spark, sf_dir)
    top = usage.top_dashboard().select(F.col("name").alias("_top"))
    types = usage.tables.dashboard_types
    doomed = types.join(top, F.col("name") == F.col("_top"), "left_semi").select("id")
    return removal.purge_types(usage.tables, doomed)


@query
def purge_types(spark, sf_dir):
    return without_top_type(spark, sf_dir).dashboard_types


@query
def purge_types_links(spark, sf_dir):
    return without_top_type(spark, sf_dir).dashboard_links


def extended(spark: SparkSession, sf_dir: str) -> Tables:
    return replace(testbed.tables(spark, sf_dir), positions=pin(upserted_positions(spark, sf_dir)))


@query
def delete_guard(spark, sf_dir):
    tables = extended(spark, sf_dir)
    return removal.guard_positions(tables, tables.positions.select("id"))


@query
def delete_positions(spark, sf_dir):
    tables = extended(spark, sf_dir)
    return removal.delete_positions(tables, tables.positions.select("id")).positions


@query
def integrity_audit(spark, sf_dir):
    """Findings after careless edits that break every rule once."""
    tables = testbed.tables(spark, sf_dir)
    people, pairs, links, sessions = tables.users, tables.user_positions, tables.dashboard_links, tables.sessions()
    left = removal.without(people, "id", overdrawn(spark, sf_dir).select("c_custkey"))
    again = people.where("id % 50 = 1").withColumn("id", F.col("id") + 1_000_000)
    nowhere = pairs.where("user_id % 13 = 0").withColumn("position_id", F.lit(999).cast("long"))
    lost = links.where("id % 5 = 0").withColumns(
        {"position_id": F.lit(999).cast("long"), "dashboard_type_id": F.lit(99).cast("long")}
    )
    careless = replace(
        tables,
        users=left.unionByName(again),
        positions=tables.positions.unionByName(
            position_changes(spark, sf_dir).withColumnRenamed("seq", "id")
        ),
        user_positions=pairs.unionByName(pairs.where("user_id % 7 = 0")).unionByName(nowhere),
        dashboard_links=links.unionByName(lost),
        session_source=from_frame(sessions.unionByName(sessions.where("user_id % 11 = 0"))),
    )
    return integrity.audit(careless)


@query
def integrity_of_changed_days(spark, sf_dir):
    """The fact rules after one stored day was written again with repeated sessions and users were lost."""
    tables = testbed.tables(spark, sf_dir)
    folder, sessions = run_dir(spark, "audited"), tables.sessions()
    write_sessions(sessions, f"{folder}/facts")
    kept = integrity.FactAudit(spark, f"{folder}/facts", f"{folder}/audit", sessions.schema)
    kept.refresh()
    day = sessions.where(F.col("session_date") == F.lit(START))
    write_sessions(day.unionByName(day.where("user_id % 11 = 0")), f"{folder}/facts")
    kept.refresh()
    return kept.findings(removal.without(tables.users, "id", overdrawn(spark, sf_dir).select("c_custkey")))


@query
def drop_legacy(spark, sf_dir):
    """Users in the older layout, with one position in the row, brought to the new one."""
    legacy = users(spark, sf_dir).join(
        testbed.read(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("position_id")
        ),
        "id",
    )
    return drop_legacy_columns(legacy, "users")


@query
def credentials_ready(spark, sf_dir):
    """Users with everything needed to be written to."""
    return split_by_required(users(spark, sf_dir), ["username", "name", "email"])[0]


@query
def credentials_rejected(spark, sf_dir):
    return split_by_required(users(spark, sf_dir), ["username", "name", "email"])[1]


# -- edits by id -----------------------------------------------------------------------------------


def shifted_ids(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Every third id of a domain table, each with an id nobody has."""
    ids = getattr(testbed.tables(spark, sf_dir), table).where("id % 3 = 0").select("id")
    return ids.select(F.explode(F.array("id", F.col("id") + 1_000_000)).alias("id"))


@query
def update_links(spark, sf_dir):
    wanted = shifted_ids(spark, sf_dir, "dashboard_links").withColumn("url", F.concat(F.lit("https://moved.example/"), "id"))
    return changes.update_by_key(testbed.tables(spark, sf_dir).dashboard_links, wanted, ["id"])


@query
def delete_links(spark, sf_dir):
    return removal.without(
        testbed.tables(spark, sf_dir).dashboard_links, "id", shifted_ids(spark, sf_dir, "dashboard_links")
    )


@query
def update_types(spark, sf_dir):
    """Types renamed after the nations with their ids; ids without a type change nothing."""
    wanted = testbed.read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")
    )
    return changes.update_by_key(testbed.tables(spark, sf_dir).dashboard_types, wanted, ["id"])


@query
def update_positions(spark, sf_dir):
    wanted = shifted_ids(spark, sf_dir, "positions").withColumn("can_view_metrics", F.lit(True))
    return changes.update_by_key(testbed.tables(spark, sf_dir).positions, wanted, ["id"])


def clashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses for usernames: two different ones for some, the same one twice for others."""
    who = testbed.read(spark, sf_dir, "customer").where("c_custkey % 4 <> 3")
    other = F.when(F.col("c_custkey") % 4 == 0, F.lit("b@x.example")).otherwise(F.lit("a@x.example"))
    return who.select(
        F.lower("c_name").alias("username"), F.explode(F.array(F.lit("a@x.example"), other)).alias("email")
    )


@query
def upsert_without_order(spark, sf_dir):
    """Usernames with one change are updated, those with two are left alone."""
    return changes.upsert(users(spark, sf_dir), clashing(spark, sf_dir), ["username"], id_column="id")


@query
def upsert_conflicts(spark, sf_dir):
    return changes.conflicts(clashing(spark, sf_dir), ["username"])


@query
def revise_users_rejected(spark, sf_dir):
    """Customers ask for the name of another, for names twice, and for a position nobody has."""
    wanted = testbed.read(spark, sf_dir, "customer").where("c_custkey % 5 < 3").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit("customer#000000003"))
        .when(F.col("c_custkey") % 5 == 1, F.lit("twice"))
        .otherwise(F.lower("c_name"))
        .alias("username"),
        F.col("c_name").alias("name"),
        F.lit(None).cast("string").alias("email"),
        F.lit("user").alias("role"),
        F.array(F.lit(99).cast("long"), F.col("c_nationkey").cast("long")).alias("position_ids"),
    )
    return directory.revise_users(testbed.tables(spark, sf_dir), wanted).refused
