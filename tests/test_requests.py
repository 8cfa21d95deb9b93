"""Many requests at once against one report each."""

import random
from datetime import timedelta

import pytest
from conftest import DAY, person, session_row

from boardpulse.plans.params import ReportParams
from boardpulse.plans.report import UsageReport
from boardpulse.plans.requests import MEASURES, REQUESTS, base_kpis_of
from boardpulse.sources.feeds import seed_rows

AS_OF = DAY + timedelta(days=9)


@pytest.fixture
def tables(make_tables):
    dice = random.Random(12)
    ids = [1, 2, 3, 4, 32_768, 32_769, None]
    keys = sorted({(dice.choice(ids), dice.choice(["https://a", "https://b", "https://c", None]), DAY + timedelta(days=dice.randrange(14))) for _ in range(160)}, key=str)
    return make_tables(
        users=[person(1, role="admin"), person(2), person(3), person(32_768, role="admin"), person(32_769)],
        positions=[(1, "P", True), (2, "Q", False)],
        user_positions=[(1, 1), (2, 1), (2, 1), (32_769, 1), (3, 2)],
        types=[(1, "Ventas", None), (2, "Stock", None), (3, "Stock", None)],
        links=[(1, 1, 1, "https://a"), (2, 2, 1, "https://a"), (3, 1, 2, "https://a"), (4, 1, 2, "https://b"), (5, 1, 3, "https://b")],
        sessions=[session_row(n, user, page, day, minutes=n % 7) for n, (user, page, day) in enumerate(keys)],
    )


def one_by_one(tables, row):
    _, start, end, position, board, user, admins = row
    report = UsageReport(tables, ReportParams(start, end, position, board, user, bool(admins)), as_of=AS_OF)
    cur, prev = report.base_kpis().first(), report.base_kpis_previous().first()
    return tuple(cur[name] for name in MEASURES) + tuple(prev[name] for name in MEASURES)


def test_each_request_equals_its_report(spark, tables):
    day = [DAY + timedelta(days=n) for n in range(14)]
    rows = [
        (1, day[2], day[6], None, None, None, None),
        (2, None, None, None, None, None, True),
        (3, day[0], day[13], 1, None, None, False),
        (4, day[3], day[3], None, "Ventas", None, True),
        (5, day[3], day[12], None, "Stock", None, False),
        (6, day[1], None, 1, "Stock", 2, True),
        (7, None, day[4], 2, None, 2, False),
        (8, day[2], day[6], None, "Nada", None, False),
        (9, day[2], day[9], 9, None, None, False),
        (10, day[8], day[2], None, None, None, False),
        (11, day[2], day[6], None, None, 32_768, False),
        (12, day[2], day[6], None, None, 32_768, True),
    ]
    found = base_kpis_of(tables, seed_rows(spark, rows, REQUESTS), AS_OF).collect()
    assert len(found) == len(rows)
    answers = {r["request_id"]: tuple(r[f"{p}_{name}"] for p in ("cur", "prev") for name in MEASURES) for r in found}
    assert answers == {row[0]: one_by_one(tables, row) for row in rows}


def test_facts_are_read_once_whatever_the_requests(spark, tables):
    reads = []

    def source(ranges):
        reads.append(tuple(ranges))
        return tables.session_source(ranges)

    from dataclasses import replace

    rows = [(n, DAY + timedelta(days=n % 5), DAY + timedelta(days=n % 5 + 2), None, None, None, False) for n in range(300)]
    found = base_kpis_of(replace(tables, session_source=source), seed_rows(spark, rows, REQUESTS), AS_OF)
    assert found.count() == 300
    # Two days of requests reach back as far again before the earliest one.
    assert reads == [((DAY - timedelta(days=3), DAY + timedelta(days=6)),)]


def test_no_requests_and_no_facts(spark, tables, make_tables):
    none = seed_rows(spark, [], REQUESTS)
    assert base_kpis_of(tables, none, AS_OF).collect() == []
    one = base_kpis_of(make_tables(), seed_rows(spark, [(1, None, None, 1, "Ventas", 2, True)], REQUESTS), AS_OF).first()
    assert [one[f"{p}_{name}"] for p in ("cur", "prev") for name in MEASURES] == [0] * 6
    assert one["avg_sessions_user"] is None


def test_users_are_counted_without_one_bitmap_per_request(spark, make_tables):
    days = [DAY + timedelta(days=n) for n in range(6)]
    dice = random.Random(5)
    # Users of many bitmap buckets, who come on several days or on one.
    people = [n * 32_768 + 7 for n in range(12)]
    seen = sorted({(user, dice.choice(["https://a", "https://b"]), dice.choice(days)) for user in people for _ in range(3)})
    tables = make_tables(
        users=[person(user, role="admin" if n % 4 == 0 else "user") for n, user in enumerate(people)],
        positions=[(1, "P", True)],
        user_positions=[(user, 1) for user in people[::2]],
        types=[(1, "Ventas", None)],
        links=[(1, 1, 1, "https://a")],
        sessions=[session_row(n, user, page, day) for n, (user, page, day) in enumerate(seen)],
    )
    asked = [(low, high, place, board, None, admins) for low in days for high in days for place in (None, 1) for board in (None, "Ventas") for admins in (False, True)]
    rows = [(n, *question) for n, question in enumerate(2 * asked)]
    found = base_kpis_of(tables, seed_rows(spark, rows, REQUESTS), AS_OF)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap_" not in plan
    holders, hidden = set(people[::2]), set(people[::4])

    def users(low, high, place, board, _, admins):
        there = {user for user, page, day in seen if low <= day <= high and (board is None or page == "https://a")}
        return len((there & holders if place else there) - (hidden if admins else set()))

    assert {r["request_id"]: r["cur_unique_users"] for r in found.collect()} == {n: users(*question) for n, *question in rows}
