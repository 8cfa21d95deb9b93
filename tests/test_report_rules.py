"""One test per rule of the report, on literal tables."""

import json
from datetime import date, timedelta

import pytest
from conftest import DAY, person, session_row

from boardpulse import ReportParams, UsageReport

A, B, C = "https://a", "https://b", "https://c"


def day_report(tables, **filters):
    return UsageReport(tables, ReportParams(start_date=DAY, end_date=DAY, **filters), DAY)


def one(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0]


def base(report):
    return tuple(one(report.base_kpis()))


def names(frame):
    return [(row["name"], row["count"]) for row in frame.collect()]


@pytest.fixture
def two_types(make_tables):
    """A shows two types (one of them on two positions), B one, C none."""
    return make_tables(
        users=[person(1), person(2), person(3, role="admin")],
        positions=[(1, "P1", True), (2, "P2", False)],
        user_positions=[(1, 1), (1, 2), (2, 2)],
        types=[(1, "Sales", None), (2, "Stock", None), (3, "Admin", None), (4, None, None), (5, "Sales", None)],
        links=[(1, 1, 1, A), (2, 2, 1, A), (3, 1, 2, A), (4, 1, 5, B), (5, 1, 3, C), (6, 1, 4, C)],
        sessions=[
            session_row(1, 1, A, DAY, 10),
            session_row(2, 2, B, DAY, 5),
            session_row(3, 2, "LOGIN_PORTAL", DAY, 1),
            session_row(4, 3, C, DAY, 7),
            session_row(5, 1, A, DAY - timedelta(days=1), 4),
        ],
    )


def test_url_with_two_types_counts_twice(two_types):
    # A: 2 x 10, B: 5, login: 1, C: 2 x 7
    assert base(day_report(two_types)) == (40, 6, 3)


def test_dashboard_filter_counts_matching_types_only(two_types):
    assert base(day_report(two_types, dashboard_name="Sales")) == (15, 2, 2)
    assert base(day_report(two_types, dashboard_name="Stock")) == (10, 1, 1)
    assert base(day_report(two_types, dashboard_name="Nothing")) == (0, 0, 0)


def test_position_and_user_filters(two_types):
    assert base(day_report(two_types, position_id=1)) == (20, 2, 1)
    assert base(day_report(two_types, position_id=2)) == (26, 4, 2)
    assert base(day_report(two_types, user_id=2)) == (6, 2, 1)
    assert base(day_report(two_types, user_id=2, position_id=1)) == (0, 0, 0)


def test_filters_leave_other_sections_alone(two_types):
    plain, filtered = day_report(two_types), day_report(two_types, position_id=1, user_id=2, dashboard_name="Stock")
    for section in ("adoption", "top_dashboard", "over_time", "by_dashboard", "by_position", "engagement", "top_users"):
        assert getattr(plain, section)().collect() == getattr(filtered, section)().collect()


def test_admins_are_left_out_everywhere_but_the_denominator(two_types):
    report = day_report(two_types, exclude_admins=True)
    assert base(report) == (26, 4, 2)
    adoption = one(report.adoption())
    assert (adoption["total_users"], adoption["active_users_30d"]) == (3, 2)
    assert one(report.over_time())["count"] == 3
    assert [row["name"] for row in report.top_users().collect()] == ["Name 2", "Name 1"]


def test_breakdown_merges_names_and_drops_reserved_and_nameless(two_types):
    assert names(day_report(two_types).by_dashboard()) == [("Sales", 2), ("Stock", 1)]


def test_position_breakdown_counts_each_position(two_types):
    assert names(day_report(two_types).by_position()) == [("P2", 3), ("P1", 1)]


def test_null_user_with_and_without_admins(make_tables):
    facts = [session_row(1, None, A, DAY), session_row(2, 2, A, DAY)]
    with_admin = make_tables(users=[person(1, role="admin"), person(2)], sessions=facts)
    without = make_tables(users=[person(2)], sessions=facts)
    assert base(day_report(with_admin, exclude_admins=True)) == (1, 1, 1)
    assert base(day_report(without, exclude_admins=True)) == (2, 2, 1)
    assert base(day_report(with_admin)) == (2, 2, 1)
    assert one(day_report(with_admin, exclude_admins=True).over_time())["count"] == 1
    assert one(day_report(without, exclude_admins=True).over_time())["count"] == 2
    # The nameless user is one user of the histogram.
    assert one(day_report(without).engagement())["user_count"] == 2


def test_active_window_is_anchored_at_today_and_open_ended(make_tables):
    tables = make_tables(
        users=[person(n) for n in range(1, 5)],
        sessions=[
            session_row(1, 1, A, DAY - timedelta(days=30)),
            session_row(2, 2, A, DAY - timedelta(days=31)),
            session_row(3, 3, A, DAY + timedelta(days=5)),
        ],
    )
    old = date(2023, 1, 1)
    report = UsageReport(tables, ReportParams(start_date=old, end_date=old), DAY)
    assert tuple(one(report.adoption())) [:2] == (4, 2)


def test_orphans_can_make_inactive_negative(make_tables):
    tables = make_tables(users=[person(1)], sessions=[session_row(n, n, A, DAY) for n in range(1, 4)])
    assert one(day_report(tables).adoption())["inactive_users_count"] == -2


def test_averages_of_nothing_are_null_and_variation_of_nothing_is_zero(make_tables):
    report = day_report(make_tables())
    assert tuple(one(report.averages())) == (None, None)
    assert tuple(one(report.variations())) == (0, 0, 0)
    assert one(report.adoption())["adoption_rate"] is None


def test_variation_rounds_half_away_from_zero(make_tables):
    before = DAY - timedelta(days=1)
    previous = [session_row(n, 1, f"u{n}", before) for n in range(8)]
    up = [session_row(100 + n, 1, f"u{n}", DAY) for n in range(9)]
    down = [session_row(100 + n, 1, f"u{n}", DAY) for n in range(7)]
    # 1/8 is 12.5 percent
    assert one(day_report(make_tables(sessions=previous + up)).variations())["var_sessions"] == 13
    assert one(day_report(make_tables(sessions=previous + down)).variations())["var_sessions"] == -13


def test_durations_of_null_and_zero(make_tables):
    tables = make_tables(
        users=[person(1)], sessions=[session_row(1, 1, A, DAY, None), session_row(2, 1, B, DAY, 0)]
    )
    assert base(day_report(tables)) == (0, 2, 1)
    only_null = make_tables(users=[person(1)], sessions=[session_row(1, 1, A, DAY, None)])
    assert one(day_report(only_null).top_users())["minutes"] is None


def test_series_fills_gaps_and_is_empty_when_reversed(make_tables):
    tables = make_tables(sessions=[session_row(1, 1, A, DAY), session_row(2, 2, "LOGIN_PORTAL", DAY)])
    report = UsageReport(
        tables, ReportParams(start_date=DAY - timedelta(days=2), end_date=DAY + timedelta(days=1)), DAY
    )
    assert [row["count"] for row in report.over_time().collect()] == [0, 0, 2, 0]
    reversed_report = UsageReport(tables, ReportParams(start_date=DAY, end_date=DAY - timedelta(days=1)), DAY)
    assert reversed_report.over_time().collect() == []
    assert base(reversed_report) == (0, 0, 0)
    assert json.loads(one(reversed_report.document())["document"])["over_time"] == []


def test_histogram_segments(make_tables):
    counts = {1: 1, 2: 2, 3: 5, 4: 6, 5: 10, 6: 11}
    facts = [
        session_row(user * 100 + n, user, f"u{n}", DAY) for user, many in counts.items() for n in range(many)
    ]
    rows = day_report(make_tables(users=[person(1)], sessions=facts)).engagement_shares().collect()
    assert [(row["segment"], row["user_count"]) for row in rows] == [
        ("1 Sesión", 1),
        ("2-5 Sesiones", 2),
        ("6-10 Sesiones", 2),
        ("+10 Sesiones", 1),
    ]
    assert sum(row["share"] for row in rows) == pytest.approx(100.0)


def test_leaderboard_merges_namesakes_and_breaks_ties_by_name(make_tables):
    people = [person(1, "Twin"), person(2, "Twin")] + [person(n, f"N{n:02d}") for n in range(3, 15)]
    facts = [session_row(n, n, A, DAY) for n in range(1, 15)]
    rows = day_report(make_tables(users=people, sessions=facts)).top_users().collect()
    assert [row["name"] for row in rows] == ["Twin"] + [f"N{n:02d}" for n in range(3, 12)]
    assert rows[0]["sessions"] == 2


def test_top_dashboard_tie_and_default(make_tables):
    tables = make_tables(
        types=[(1, "Zeta", None), (2, "Alfa", None)],
        links=[(1, 1, 1, A), (2, 1, 2, B)],
        sessions=[session_row(1, 1, A, DAY), session_row(2, 1, B, DAY)],
    )
    assert tuple(one(day_report(tables).top_dashboard())) == ("Alfa", 1)
    assert tuple(one(day_report(make_tables()).top_dashboard())) == ("N/A", 0)


def test_document_of_nothing_keeps_nulls_and_empty_lists(make_tables):
    document = json.loads(one(day_report(make_tables()).document())["document"])
    assert list(document) == ["kpis", "over_time", "by_dashboard", "by_position", "engagement", "top_users"]
    assert list(document["kpis"]) == [
        "active_users_30d", "adoption_rate", "total_sessions", "avg_sessions_user", "avg_time_session",
        "top_dashboard", "inactive_users_count", "var_active_30d", "var_sessions", "var_time",
    ]
    assert document["kpis"]["adoption_rate"] is None
    assert document["kpis"]["top_dashboard"] == {"name": "N/A", "count": 0}
    assert document["by_dashboard"] == document["engagement"] == document["top_users"] == []
    assert document["over_time"] == [{"date": DAY.isoformat(), "count": 0}]


def test_document_equals_its_sections(two_types):
    report = day_report(two_types, position_id=2, exclude_admins=True)
    document = json.loads(one(report.document())["document"])
    assert document["kpis"]["total_sessions"] == one(report.base_kpis())["total_sessions"]
    assert document["by_dashboard"] == [row.asDict() for row in report.by_dashboard().collect()]
    assert document["by_position"] == [row.asDict() for row in report.by_position().collect()]
    assert document["top_users"] == [row.asDict() for row in report.top_users().collect()]


def test_cards(make_tables):
    tables = make_tables(
        users=[person(n) for n in range(1, 3)],
        sessions=[session_row(1, 1, A, DAY, 1)]
        + [session_row(n, 1, f"u{n}", DAY - timedelta(days=1)) for n in range(2, 6)],
    )
    cards = {row["label"]: row for row in day_report(tables).cards().collect()}
    assert [row["position"] for row in day_report(tables).cards().collect()] == list(range(1, 8))
    assert cards["% Adopción"]["value"] == "50%"
    assert (cards["Total Sesiones"]["change_percent"], cards["Total Sesiones"]["trend"]) == (75, "down")
    assert (cards["Activos (30d)"]["change_percent"], cards["Activos (30d)"]["trend"]) == (0, "up")
    assert cards["Avg Tiempo"]["value"] == "1m"
    assert (cards["Top Tablero"]["value"], cards["Top Tablero"]["note"]) == ("N/A", "0 accesos")
    assert cards["Inactivos"]["note"] == "---"


def test_zero_length_period_before_itself(make_tables):
    tables = make_tables(sessions=[session_row(1, 1, A, DAY)])
    report = UsageReport(tables, ReportParams(start_date=DAY, end_date=DAY - timedelta(days=1)), DAY)
    assert tuple(one(report.variations())) == (0, 0, 0)
