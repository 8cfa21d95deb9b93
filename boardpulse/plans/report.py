"""The usage report: period KPIs against the period before, series, breakdowns, rankings."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardpulse.functions.calendar import DayRange, Period, today_in, within_days
from boardpulse.functions.numbers import ratio, share_percent, variation
from boardpulse.functions.text import plain_number
from boardpulse.operators.links import names_of_urls, url_weights
from boardpulse.operators.scope import drop_admins, restrict_users
from boardpulse.operators.spine import day_spine
from boardpulse.plans.params import ReportParams
from boardpulse.session import pin
from boardpulse.sources.tables import Tables

# Reach of the activity window, ranking length, engagement segments, defaults.
ACTIVE_DAYS = 30
TOP_USERS = 10
SEGMENTS = ("1 Sesión", "2-5 Sesiones", "6-10 Sesiones", "+10 Sesiones")
NO_DASHBOARD = "N/A"

BASE_COLUMNS = ("total_minutes", "total_sessions", "unique_users")


class UsageReport:
    """All sections of one report, each a lazy DataFrame.

    Facts are reduced once per user and once per URL and day; every section starts from
    one of the two. Filters on position, dashboard and user shape the base KPIs only,
    the exclusion of admins shapes everything but the number of users.
    """

    def __init__(self, tables: Tables, params: ReportParams | None = None, as_of: date | None = None):
        self.tables = tables
        self.params = params or ReportParams()
        self.as_of = as_of or today_in()
        self.period = self.params.period(self.as_of)
        self._pinned_users: DataFrame | None = None
        self._pinned_days: DataFrame | None = None
        self._shared: UsageReport | None = None

    # -- ranges ---------------------------------------------------------------

    @property
    def previous(self) -> Period:
        return self.period.previous()

    @property
    def active_range(self) -> DayRange:
        """Reaches back from today, whatever period is asked for, and has no end."""
        return (self.as_of - timedelta(days=ACTIVE_DAYS), None)

    def _in(self, *ranges: DayRange) -> Column:
        return within_days(F.col("session_date"), ranges)

    # -- shared reductions ------------------------------------------------------

    def _per_user(
        self,
        base: tuple[str, ...] = (),
        totals: bool = False,
        active: bool = False,
    ) -> DataFrame:
        """One row per user with whichever measures a section needs.

        ``base`` asks for the weighted measures of the current and previous period
        ("cur", "prev"), ``totals`` for plain sessions and minutes of the period,
        ``active`` for the 30-day flag. User-level filters can wait until here, where
        there is one row per user to test.
        """
        if self._pinned_users is not None:
            return self._pinned_users
        compared = {"cur": self.period, "prev": self.previous}
        ranges = [compared[prefix].as_range() for prefix in base]
        if totals and "cur" not in base:
            ranges.append(self.period.as_range())
        if active:
            ranges.append(self.active_range)
        facts = self.tables.sessions(*ranges)
        here = self._in(self.period.as_range())
        firsts, sums = [], []
        if totals:
            firsts += [
                F.count(F.when(here, F.col("id"))).alias("sessions"),
                F.sum(F.when(here, F.col("duration_minutes"))).alias("minutes"),
            ]
            sums += [F.sum("sessions").alias("sessions"), F.sum("minutes").alias("minutes")]
        if active:
            firsts.append(F.bool_or(self._in(self.active_range)).alias("active"))
            sums.append(F.bool_or("active").alias("active"))
        if not base:
            return self._without_admins(facts.groupBy("user_id").agg(*firsts))
        # Weights belong to pages: facts are reduced to one row per user and page before they meet.
        for prefix in base:
            inside = self._in(compared[prefix].as_range())
            firsts += [
                F.count(F.when(inside, F.lit(1))).alias(f"_{prefix}_n"),
                F.sum(F.when(inside, F.col("duration_minutes"))).alias(f"_{prefix}_minutes"),
            ]
            for measure, name in (("n", "sessions"), ("minutes", "minutes")):
                weighted = F.sum(F.col("weight") * F.col(f"_{prefix}_{measure}"))
                sums.append(F.coalesce(weighted, F.lit(0)).alias(f"{prefix}_base_{name}"))
        name = self.params.dashboard_name
        weights = url_weights(self.tables.dashboard_links, self.tables.dashboard_types, name)
        pages = facts.groupBy("user_id", "dashboard_url").agg(*firsts)
        weighed = pages.join(weights, F.col("dashboard_url") == F.col("_url"), "left").withColumn(
            "weight", F.coalesce("weight", F.lit(1 if name is None else 0))
        )
        return self._without_admins(weighed.groupBy("user_id").agg(*sums))

    def _without_admins(self, frame: DataFrame) -> DataFrame:
        if not self.params.exclude_admins:
            return frame
        return drop_admins(frame, self.tables.users)

    def _scoped(self, per_user: DataFrame) -> DataFrame:
        return restrict_users(
            per_user, self.tables.user_positions, self.params.position_id, self.params.user_id
        )

    def _per_url_day(self) -> DataFrame:
        """Sessions of the period per URL and day, small enough to join freely."""
        if self._pinned_days is not None:
            return self._pinned_days
        facts = self._without_admins(self.tables.sessions(self.period.as_range()))
        return facts.groupBy("dashboard_url", "session_date").agg(F.count("id").alias("sessions"))

    # -- base KPIs ----------------------------------------------------------------

    @staticmethod
    def _totals(prefix: str) -> list[Column]:
        sessions = F.col(f"{prefix}_base_sessions")
        return [
            F.coalesce(F.sum(f"{prefix}_base_minutes"), F.lit(0)).alias("total_minutes"),
            F.coalesce(F.sum(sessions), F.lit(0)).alias("total_sessions"),
            F.count(F.when(sessions > 0, F.col("user_id"))).alias("unique_users"),
        ]

    def base_kpis(self) -> DataFrame:
        """Minutes, sessions and users of the period under all filters."""
        return self._scoped(self._per_user(("cur",))).agg(*self._totals("cur"))

    def base_kpis_previous(self) -> DataFrame:
        """The same for the period before."""
        return self._scoped(self._per_user(("prev",))).agg(*self._totals("prev"))

    def _both_periods(self) -> DataFrame:
        per_user = self._scoped(self._per_user(("cur", "prev")))
        columns = [
            column.alias(f"{prefix}_{name}")
            for prefix in ("cur", "prev")
            for name, column in zip(BASE_COLUMNS, self._totals(prefix))
        ]
        return per_user.agg(*columns)

    @staticmethod
    def _average_columns() -> list[Column]:
        return [
            ratio(F.col("cur_total_sessions"), F.col("cur_unique_users")).alias("avg_sessions_user"),
            ratio(F.col("cur_total_minutes"), F.col("cur_total_sessions")).alias("avg_time_session"),
        ]

    @staticmethod
    def _variation_columns() -> list[Column]:
        # The first one is named after the 30-day figure but compares the two periods.
        return [
            variation(F.col(f"cur_{name}"), F.col(f"prev_{name}")).alias(label)
            for label, name in (
                ("var_active_30d", "unique_users"),
                ("var_sessions", "total_sessions"),
                ("var_time", "total_minutes"),
            )
        ]

    def averages(self) -> DataFrame:
        """Sessions per user and minutes per session; NULL without any."""
        totals = self._scoped(self._per_user(("cur",))).agg(
            *[column.alias(f"cur_{name}") for name, column in zip(BASE_COLUMNS, self._totals("cur"))]
        )
        return totals.select(*self._average_columns())

    def variations(self) -> DataFrame:
        """Change of users, sessions and minutes against the period before, in percent."""
        return self._both_periods().select(*self._variation_columns())

    # -- adoption -------------------------------------------------------------------

    def _active_users(self) -> DataFrame:
        active = F.when(F.col("active"), F.col("user_id"))
        return self._per_user(active=True).agg(F.count(active).alias("active_users_30d"))

    def adoption(self) -> DataFrame:
        """Active users of the last thirty days against all users."""
        counted = self.tables.users.agg(F.count("*").alias("total_users")).withColumn(
            "active_users_30d", self._active_users().scalar()
        )
        return counted.select(
            "total_users",
            "active_users_30d",
            ratio(F.col("active_users_30d"), F.col("total_users"), scale=100).alias("adoption_rate"),
            (F.col("total_users") - F.col("active_users_30d")).alias("inactive_users_count"),
        )

    # -- series and breakdowns --------------------------------------------------------

    def over_time(self) -> DataFrame:
        """Sessions per day, days without any included."""
        return self._over_time().orderBy("date")

    def _over_time(self) -> DataFrame:
        daily = self._per_url_day().groupBy("session_date").agg(F.sum("sessions").alias("_count"))
        spine = day_spine(self.tables.spark, self.period)
        return (
            spine.join(daily, F.col("date") == F.col("session_date"), "left")
            .select("date", F.coalesce("_count", F.lit(0)).cast("long").alias("count"))
        )

    def _by_dashboard(self) -> DataFrame:
        names = names_of_urls(self.tables.dashboard_links, self.tables.dashboard_types)
        per_url = self._per_url_day().groupBy("dashboard_url").agg(F.sum("sessions").alias("_count"))
        named = per_url.join(names, F.col("dashboard_url") == F.col("_url"))
        return named.groupBy("name").agg(F.sum("_count").alias("count"))

    def by_dashboard(self) -> DataFrame:
        """Sessions per dashboard name, once for each type behind the page."""
        return self._by_dashboard().orderBy(F.desc("count"), "name")

    def top_dashboard(self) -> DataFrame:
        """The dashboard with most sessions, the first by name among equals."""
        best = F.min(F.struct((-F.col("count")).alias("rank"), "name"))
        return (
            self._by_dashboard()
            .agg(best.alias("best"))
            .select(
                F.coalesce("best.name", F.lit(NO_DASHBOARD)).alias("name"),
                F.coalesce(-F.col("best.rank"), F.lit(0)).cast("long").alias("count"),
            )
        )

    def by_position(self) -> DataFrame:
        """Sessions per position name, once for each position of the user."""
        return self._by_position().orderBy(F.desc("count"), F.asc_nulls_last("name"))

    def _by_position(self) -> DataFrame:
        held = self.tables.user_positions.join(
            self.tables.positions.select(F.col("id").alias("_position"), "name"),
            F.col("position_id") == F.col("_position"),
        ).select(F.col("user_id").alias("_holder"), "name")
        active = self._per_user(totals=True).where(F.col("sessions") > 0)
        return (
            active.join(held, F.col("user_id") == F.col("_holder"))
            .groupBy("name")
            .agg(F.sum("sessions").alias("count"))
        )

    def engagement(self) -> DataFrame:
        """Users by number of sessions in the period; empty segments are left out."""
        sessions = F.col("sessions")
        rank = F.when(sessions == 1, 0).when(sessions <= 5, 1).when(sessions <= 10, 2).otherwise(3)
        names = F.array(*[F.lit(name) for name in SEGMENTS])
        return (
            self._per_user(totals=True)
            .where(sessions > 0)
            .groupBy(rank.alias("rank"))
            .agg(F.count("*").alias("user_count"))
            .orderBy("rank")
            .select(F.get(names, F.col("rank")).alias("segment"), "user_count")
        )

    def engagement_shares(self) -> DataFrame:
        """Segments with their share of the 30-day active users in percent."""
        return self.engagement().withColumn(
            "share", share_percent(F.col("user_count"), self._active_users().scalar())
        )

    def top_users(self) -> DataFrame:
        """The ten user names with most sessions; namesakes count as one."""
        active = self._per_user(totals=True).where(F.col("sessions") > 0)
        people = self.tables.users.select(F.col("id").alias("_user"), "name")
        return (
            active.join(people, F.col("user_id") == F.col("_user"))
            .groupBy("name")
            .agg(F.sum("sessions").alias("sessions"), F.sum("minutes").alias("minutes"))
            .orderBy(F.desc("sessions"), F.asc_nulls_last("name"))
            .limit(TOP_USERS)
        )

    # -- whole report -------------------------------------------------------------------

    def shared(self) -> UsageReport:
        """The same report with both reductions computed once and kept.

        The facts are then read twice in all, whatever the number of sections.
        """
        if self._pinned_users is not None:
            return self
        if self._shared is None:
            report = UsageReport(self.tables, self.params, self.as_of)
            report._pinned_users = pin(self._per_user(("cur", "prev"), totals=True, active=True))
            report._pinned_days = pin(self._per_url_day())
            self._shared = report
        return self._shared

    def kpis(self) -> DataFrame:
        """All KPIs in one row."""
        report = self.shared()
        top = report.top_dashboard().select(F.struct("name", "count").alias("top"))
        row = report._both_periods().select(
            "*",
            report._active_users().scalar().alias("active_users_30d"),
            self.tables.users.agg(F.count("*").alias("n")).scalar().alias("total_users"),
            top.scalar().alias("top_dashboard"),
        )
        return row.select(
            "active_users_30d",
            ratio(F.col("active_users_30d"), F.col("total_users"), scale=100).alias("adoption_rate"),
            F.col("cur_total_sessions").alias("total_sessions"),
            *self._average_columns(),
            "top_dashboard",
            (F.col("total_users") - F.col("active_users_30d")).alias("inactive_users_count"),
            *self._variation_columns(),
        )

    def document(self) -> DataFrame:
        """The whole report as one JSON text in a single row.

        Sections are reduced to a handful of rows before they meet: days of the period,
        dashboard and position names, four segments, ten users.
        """
        report = self.shared()
        kpis = report.kpis()
        sections = {
            "kpis": kpis.select(F.struct(*kpis.columns).alias("kpis")),
            "over_time": _as_array(report._over_time(), [F.col("date")]),
            "by_dashboard": _as_array(report._by_dashboard(), [-F.col("count"), *_nulls_last("name")]),
            "by_position": _as_array(report._by_position(), [-F.col("count"), *_nulls_last("name")]),
            "engagement": _as_array(report.engagement(), [F.array_position(
                F.array(*[F.lit(name) for name in SEGMENTS]), F.col("segment"))]),
            "top_users": _as_array(report.top_users(), [-F.col("sessions"), *_nulls_last("name")]),
        }
        body = F.struct(*[frame.scalar().alias(name) for name, frame in sections.items()])
        return self.tables.spark.range(1).select(
            F.to_json(body, {"ignoreNullFields": "false"}).alias("document")
        )

    def cards(self) -> DataFrame:
        """KPIs in display form: label, value with its unit, change and its direction."""
        kpis = self.kpis()

        def number(name: str, suffix: str = "") -> Column:
            shown = plain_number(F.coalesce(F.col(name), F.lit(0)).cast("decimal(38,1)"))
            return F.concat(shown, F.lit(suffix))

        def count(name: str) -> Column:
            return F.coalesce(F.col(name), F.lit(0)).cast("string")

        none = F.lit(None).cast("long")
        top = F.col("top_dashboard")
        # Labels and units in display order.
        cards = [
            ("Activos (30d)", count("active_users_30d"), F.col("var_active_30d"), None),
            ("% Adopción", number("adoption_rate", "%"), none, None),
            ("Total Sesiones", count("total_sessions"), F.col("var_sessions"), None),
            ("Avg Sesiones", number("avg_sessions_user"), none, None),
            ("Avg Tiempo", number("avg_time_session", "m"), F.col("var_time"), None),
            ("Top Tablero", top["name"], none, F.concat(top["count"].cast("string"), F.lit(" accesos"))),
            ("Inactivos", count("inactive_users_count"), none, None),
        ]
        rows = [
            F.struct(
                F.lit(position).alias("position"),
                F.lit(label).alias("label"),
                value.alias("value"),
                F.abs(change).alias("change_percent"),
                F.when(change >= 0, "up").when(change < 0, "down").alias("trend"),
                F.when(change.isNull(), F.lit("---") if note is None else note).alias("note"),
            )
            for position, (label, value, change, note) in enumerate(cards, 1)
        ]
        return kpis.select(F.inline(F.array(*rows))).orderBy("position")


def _nulls_last(name: str) -> list[Column]:
    return [F.col(name).isNull(), F.col(name)]


def _as_array(frame: DataFrame, order_by: list[Column]) -> DataFrame:
    """A short result as one ordered array of structs; empty when there are no rows."""
    keys = [key.alias(f"_{number}") for number, key in enumerate(order_by)]
    items = F.sort_array(F.collect_list(F.struct(*keys, F.struct(*frame.columns).alias("item"))))
    return frame.agg(F.transform(items, lambda pair: pair["item"]).alias("items"))
