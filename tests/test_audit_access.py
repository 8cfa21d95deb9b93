from datetime import datetime, timedelta

import pytest
from conftest import DAY, person, session_row

from boardpulse.plans import access
from boardpulse.plans.audit import audit_log, recent_activity

A, B = "https://a", "https://b"


def at(hour, minute=0):
    return datetime(DAY.year, DAY.month, DAY.day, hour, minute)


@pytest.fixture
def tables(make_tables):
    return make_tables(
        users=[person(1), (2, "user2", "", None, None), person(3, role="admin"), person(4)],
        positions=[(1, "P1", None), (2, "P2", True), (3, "", False)],
        user_positions=[(1, 2), (1, 1), (2, 3), (4, 99)],
        types=[(1, "Sales", "d"), (2, "", None), (3, None, None)],
        links=[(1, 1, 1, A), (2, 2, 2, A), (3, 1, 1, B), (4, 1, 77, "https://gone")],
        sessions=[
            session_row(1, 1, A, DAY, None, start=at(1), last=at(10)),
            session_row(2, 2, B, DAY, 3, start=at(2), last=at(11)),
            session_row(3, 3, B, DAY, 3, last=at(12)),
            session_row(4, 1, "LOGIN_PORTAL", DAY, 1, last=at(13)),
            session_row(5, 1, "https://new", DAY, 0, last=None),
            session_row(6, 55, B, DAY, 2, last=at(14)),
            session_row(7, None, B, DAY, 2, last=at(15)),
            session_row(8, 4, "https://gone", DAY - timedelta(days=3), 2, last=at(9)),
        ],
    )


def ids(frame):
    return [row["id"] for row in frame.collect()]


def test_log_drops_logins_admins_and_strangers_newest_first(tables):
    assert ids(audit_log(tables)) == [5, 2, 1, 8]


def test_limit_comes_before_the_filters_and_null_pings_first(tables):
    # The newest four are 5 (never pinged), 7, 6 and 4.
    assert ids(audit_log(tables, limit=4)) == [5]
    assert ids(audit_log(tables, limit=6)) == [5, 2]


def test_day_and_user_filters_come_before_the_limit(tables):
    assert ids(audit_log(tables, start_date=DAY, limit=6)) == [5, 2]
    assert ids(audit_log(tables, end_date=DAY - timedelta(days=1), limit=1)) == [8]
    assert ids(audit_log(tables, user_id=1, limit=3)) == [5, 1]


def test_names_and_defaults(tables):
    rows = {row["id"]: row for row in audit_log(tables).collect()}
    # The newest link of A has a type with an empty name.
    assert rows[1]["dashboard_name"] == "Desconocido"
    assert rows[2]["dashboard_name"] == "Sales"
    assert rows[5]["dashboard_name"] == "General"
    assert rows[8]["dashboard_name"] == "Desconocido"
    assert rows[2]["name"] == "Usuario Desconocido"
    assert rows[1]["duration_minutes"] == 0
    assert rows[1]["position_name"] == "P1, P2"
    assert rows[2]["position_name"] == ""
    assert rows[8]["position_name"] == ""


def test_name_and_position_filters(tables):
    assert ids(audit_log(tables, dashboard_name="General")) == [5]
    assert ids(audit_log(tables, position_id=1)) == [5, 1]
    assert ids(audit_log(tables, position_id=99)) == []


def test_recent_activity(tables):
    rows = {row["id"]: row for row in recent_activity(audit_log(tables)).collect()}
    assert rows[5]["minutes"] == 1 and rows[2]["minutes"] == 3
    # 02:00 UTC is 23:00 of the day before.
    assert rows[2]["time_label"] == "23:00 | 09/03"
    assert ids(recent_activity(audit_log(tables), limit=2)) == [5, 2]


def test_time_label_of_nothing(make_tables):
    tables = make_tables(users=[person(1)], sessions=[(1, 1, A, DAY, None, None, 1)])
    assert recent_activity(audit_log(tables)).collect()[0]["time_label"] == "---"


def test_profiles(tables):
    rows = {row["id"]: row for row in access.user_profiles(tables).collect()}
    assert rows[1]["position_name"] == "P1, P2" and rows[1]["can_view_metrics"]
    assert [item["id"] for item in rows[1]["positions"]] == [1, 2]
    assert rows[3]["position_name"] is None and rows[3]["positions"] == [] and not rows[3]["can_view_metrics"]
    # A position that is gone is no position.
    assert rows[4]["position_name"] is None
    assert "password_plain" not in access.user_profiles(tables).columns


def test_metrics_viewers(tables):
    assert sorted(row["id"] for row in access.metrics_viewers(tables).collect()) == [1, 3]


def test_dashboards_repeat_and_default_names(tables):
    rows = access.user_dashboards(tables).collect()
    assert sorted(tuple(row) for row in rows if row["user_id"] == 1 and row["dashboard_name"] is not None) == [
        (1, A, ""),
        (1, A, "Sales"),
        (1, B, "Sales"),
        (1, "https://gone", "Sin Nombre"),
    ]
    assert {row["user_id"] for row in rows} == {1}


def test_directory(tables):
    rows = access.user_directory(tables).collect()
    assert [row["id"] for row in rows] == [4, 3, 2, 1]
    assert rows[3]["position_ids"] == [1, 2] and rows[3]["position_name"] == "P1, P2"
    assert rows[1]["position_ids"] == [] and rows[1]["position_name"] == ""


def test_matrix_and_catalogs(tables):
    matrix = {row["id"]: row for row in access.link_matrix(tables).collect()}
    assert matrix[4]["type_name"] is None and matrix[4]["position_name"] == "P1"
    assert matrix[1]["url_preview"] == A + "..."
    assert [row["name"] for row in access.position_catalog(tables).collect()] == ["", "P1", "P2"]
    assert [row["name"] for row in access.type_catalog(tables).collect()] == ["", "Sales", None]


def test_preview_is_cut(make_tables):
    tables = make_tables(links=[(1, 1, 1, "x" * 150)])
    assert access.link_matrix(tables).collect()[0]["url_preview"] == "x" * 100 + "..."


def test_choices_follow_the_position(tables):
    assert ids(access.users_of_position(tables, 1)) == [1]
    assert len(ids(access.users_of_position(tables))) == 4
    assert ids(access.types_of_position(tables, 1)) == [1]
    assert len(ids(access.types_of_position(tables))) == 3
