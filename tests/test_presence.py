"""Users of any period from bitmaps and sketches, against sets of ids."""

import random
from datetime import date, timedelta

import pytest
from conftest import DAY, person, session_row
from pyspark.sql import functions as F

from boardpulse.operators.presence import Presence, day_bitmaps, day_sketches, relative_error, write_presence
from boardpulse.plans.params import ReportParams
from boardpulse.plans.report import UsageReport
from boardpulse.session import run_dir
from boardpulse.sources import schemas
from boardpulse.sources.feeds import seed_rows

PAGES = ["https://a", "https://b", "LOGIN_PORTAL", None]
# Ids on both sides of the borders of buckets, where bucket numbers and bit positions change.
IDS = [1, 2, 3, 32_767, 32_768, 32_769, 65_536, 65_537, 10**12, None]


@pytest.fixture
def visits():
    dice = random.Random(3)
    rows = {(dice.choice(IDS), dice.choice(PAGES), DAY + timedelta(days=dice.randrange(8))) for _ in range(150)}
    return sorted(rows, key=str)


@pytest.fixture
def tables(make_tables, visits):
    return make_tables(
        users=[person(i, role="admin" if i in (2, 32_768) else "user") for i in IDS if i],
        positions=[(1, "P", True), (2, "Q", False)],
        user_positions=[(i, 1) for i in (1, 32_768, 65_537)] + [(5, 2)],
        types=[(1, "Ventas", None), (2, "Stock", None)],
        links=[(1, 1, 1, "https://a"), (2, 2, 1, "https://a"), (3, 1, 2, "https://b")],
        sessions=[session_row(n, user, page, day) for n, (user, page, day) in enumerate(visits)],
    )


def period_rows(spark, rows):
    return spark.createDataFrame(rows, "name string, start date, end date")


def by_hand(visits, start, end, holders=None, pages=None, admins=()):
    found = {u for u, page, day in visits if u and (start is None or day >= start) and (end is None or day <= end) and (pages is None or page in pages)}
    return len({u for u in found if (holders is None or u in holders) and u not in admins})


CASES = {
    "none": (ReportParams(), {}),
    "position": (ReportParams(position_id=1), {"holders": {1, 32_768, 65_537}}),
    "empty position": (ReportParams(position_id=9), {"holders": set()}),
    "dashboard": (ReportParams(dashboard_name="Ventas"), {"pages": {"https://a"}}),
    "user": (ReportParams(user_id=32_769), {"holders": {32_769}}),
    "admins": (ReportParams(exclude_admins=True), {"admins": {2, 32_768}}),
    "every": (
        ReportParams(position_id=1, dashboard_name="Stock", exclude_admins=True),
        {"holders": {1, 32_768, 65_537}, "pages": {"https://b"}, "admins": {2, 32_768}},
    ),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_users_of_many_periods(spark, tables, visits, case):
    params, rules = CASES[case]
    bounds = [(DAY + timedelta(days=a), DAY + timedelta(days=b)) for a in range(0, 8, 4) for b in range(a, 9, 3)]
    bounds += [(None, DAY + timedelta(days=2)), (DAY + timedelta(days=5), None), (None, None), (date(1999, 1, 1), date(1999, 2, 1))]
    rows = [(str(number), *bound) for number, bound in enumerate(bounds)]
    found = Presence(tables, day_bitmaps(tables.sessions())).users_of(period_rows(spark, rows), params)
    assert {row["name"]: row["unique_users"] for row in found.collect()} == {
        name: by_hand(visits, start, end, **rules) for name, start, end in rows
    }


@pytest.mark.parametrize("case", ["none", "every"])
def test_equal_to_the_report(spark, tables, case):
    params, _ = CASES[case]
    start, end = DAY + timedelta(days=1), DAY + timedelta(days=4)
    asked = ReportParams(start, end, params.position_id, params.dashboard_name, params.user_id, params.exclude_admins)
    report = UsageReport(tables, asked, as_of=end)
    found = Presence(tables, day_bitmaps(tables.sessions())).users_of(period_rows(spark, [("p", start, end)]), params)
    assert found.first()["unique_users"] == report.base_kpis().first()["unique_users"]


@pytest.mark.parametrize("no_admins", [False, True])
def test_adoption_equals_the_report(spark, tables, no_admins):
    params = ReportParams(exclude_admins=no_admins)
    as_of = DAY + timedelta(days=5)
    kept = Presence(tables, day_bitmaps(tables.sessions()), day_sketches(tables.sessions()))
    expected = UsageReport(tables, params, as_of=as_of).adoption().collect()
    assert kept.adoption(as_of, 30, params).collect() == expected
    # So few users are still told apart by the sketches.
    assert kept.adoption(as_of, 30, params, exact=False).collect() == expected


def test_days_are_replaced_and_read_without_the_facts(spark, tables, visits):
    folder = run_dir(spark, "presence")
    write_presence(tables.sessions(), folder)
    again = tables.sessions().where((F.col("session_date") == F.lit(DAY)) & (F.col("user_id") == 1))
    write_presence(again.unionByName(seed_rows(spark, [session_row(9_999, 3, "https://a", DAY)], schemas.SESSIONS)), folder)
    left = {(u, p, d) for u, p, d in visits if d != DAY} | {(u, p, d) for u, p, d in visits if d == DAY and u == 1} | {(3, "https://a", DAY)}
    kept = Presence.stored(spark, tables, folder)
    found = kept.users_of(period_rows(spark, [("d", DAY, DAY), ("all", None, None)]))
    assert {row["name"]: row["unique_users"] for row in found.collect()} == {
        "d": by_hand(left, DAY, DAY), "all": by_hand(left, None, None)
    }
    assert all("presence" in name for name in found.inputFiles())


def test_no_days_no_users(spark, make_tables):
    tables = make_tables()
    kept = Presence(tables, day_bitmaps(tables.sessions()), day_sketches(tables.sessions()))
    assert kept.users_of(period_rows(spark, [("p", DAY, None)])).first()["unique_users"] == 0
    assert kept.estimate([(DAY, None)]).first()["unique_users"] == 0
    assert kept.estimate([(DAY, None)], ReportParams(exclude_admins=True)).first()["unique_users"] == 0


def test_sketches_know_no_single_users(tables):
    kept = Presence(tables, day_bitmaps(tables.sessions()), day_sketches(tables.sessions()))
    with pytest.raises(ValueError):
        kept.estimate([(DAY, None)], ReportParams(position_id=1))


@pytest.mark.parametrize("users", [400_000])
def test_estimates_stay_within_their_error(spark, make_tables, users):
    facts = spark.range(users * 2).select(
        (F.col("id") % users).alias("user_id"),
        F.lit("https://a").alias("dashboard_url"),
        F.date_add(F.lit(DAY), (F.col("id") % 3).cast("int")).alias("session_date"),
    )
    tables = make_tables(users=[person(1, role="admin"), person(users + 7, role="admin")])
    kept = Presence(tables, day_bitmaps(facts), day_sketches(facts))
    exact = kept.users_of(period_rows(spark, [("p", DAY, None)])).first()["unique_users"]
    assert exact == users
    for params, expected in ((ReportParams(), users), (ReportParams(exclude_admins=True), users - 1)):
        about = kept.estimate([(DAY, DAY + timedelta(days=2))], params).first()["unique_users"]
        assert abs(about - expected) <= 3 * relative_error() * expected
        assert kept.users_of(period_rows(spark, [("p", DAY, None)]), params).first()["unique_users"] == expected
