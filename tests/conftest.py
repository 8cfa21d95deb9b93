from __future__ import annotations

import os
import sys
from datetime import date, datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from boardpulse.session import build_session  # noqa: E402
from boardpulse.sources import schemas  # noqa: E402
from boardpulse.sources.feeds import seed_rows  # noqa: E402
from boardpulse.sources.tables import Tables, from_frame  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        app="boardpulse-tests",
        master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


def session_row(number, user, url, day, minutes=1, start=None, last="same"):
    """A fact row; times default to noon UTC of the day."""
    noon = datetime.combine(day, datetime.min.time()).replace(hour=12)
    begun = start or noon
    return (number, user, url, day, begun, noon if last == "same" else last, minutes)


@pytest.fixture
def make_tables(spark):
    """Domain tables from literal rows; absent tables are empty."""

    def make(users=(), positions=(), user_positions=(), types=(), links=(), sessions=()) -> Tables:
        return Tables(
            users=seed_rows(spark, users, schemas.USERS),
            positions=seed_rows(spark, positions, schemas.POSITIONS),
            user_positions=seed_rows(spark, user_positions, schemas.USER_POSITIONS),
            dashboard_types=seed_rows(spark, types, schemas.DASHBOARD_TYPES),
            dashboard_links=seed_rows(spark, links, schemas.DASHBOARD_LINKS),
            session_source=from_frame(seed_rows(spark, sessions, schemas.SESSIONS)),
        )

    return make


def person(number, name=None, role="user", email=None):
    return (number, f"user{number}", name or f"Name {number}", email, role)


DAY = date(2024, 3, 10)
