from datetime import date, datetime, timezone

import pytest
from hypothesis import given
from hypothesis import strategies as st

from boardpulse.functions import calendar
from boardpulse.functions.calendar import Period, fixed_offset, preset_bounds
from boardpulse.plans.params import ReportParams

TODAY = date(2024, 3, 10)


def test_both_bounds_default_to_eight_days():
    period = ReportParams().period(TODAY)
    assert (period.start, period.end, period.days) == (date(2024, 3, 3), TODAY, 8)


def test_bounds_default_independently():
    assert ReportParams(end_date=date(2024, 1, 10)).period(TODAY).start == date(2024, 1, 3)
    assert ReportParams(start_date=date(2024, 3, 1)).period(TODAY).end == TODAY


@given(st.dates(date(2000, 1, 1), date(2100, 1, 1)), st.integers(0, 400))
def test_previous_period_is_adjacent_and_equally_long(start, length):
    period = Period(start, date.fromordinal(start.toordinal() + length))
    before = period.previous()
    assert before.days == period.days
    assert (period.start - before.end).days == 1


def test_presets():
    assert preset_bounds("this_month", date(2024, 2, 5)) == (date(2024, 2, 1), date(2024, 2, 29))
    assert preset_bounds("this_month", date(2024, 12, 31)) == (date(2024, 12, 1), date(2024, 12, 31))
    assert preset_bounds("30d", TODAY) == (date(2024, 2, 9), TODAY)
    assert preset_bounds("reset", TODAY) == (None, None)
    with pytest.raises(ValueError):
        preset_bounds("forever", TODAY)


def test_snake_case_wins_and_empty_is_absent():
    params = ReportParams.from_query(
        {"from": "2024-01-01", "start_date": "2024-02-01", "to": "2024-02-03", "end_date": "", "positionId": "4"}
    )
    assert params.start_date == date(2024, 2, 1)
    assert params.end_date == date(2024, 2, 3)
    assert params.position_id == 4
    assert params.dashboard_name is None


def test_admin_flag_is_the_text_true():
    assert ReportParams.from_query({"exclude_admins": "true"}).exclude_admins
    assert not ReportParams.from_query({"exclude_admins": "1"}).exclude_admins
    assert not ReportParams.from_query({}).exclude_admins


@pytest.mark.parametrize("query", [{"user_id": "abc"}, {"position_id": "7x"}, {"start_date": "yesterday"}])
def test_junk_is_refused(query):
    with pytest.raises(ValueError):
        ReportParams.from_query(query)


def test_offsets():
    assert fixed_offset("Etc/GMT+3").total_seconds() == -3 * 3600
    assert fixed_offset("America/Argentina/Buenos_Aires") is None  # it had others before
    assert fixed_offset("Europe/Madrid") is None


@pytest.mark.parametrize(
    "instant, zone, expected",
    [
        ("2024-03-10T02:59:59", "America/Argentina/Buenos_Aires", date(2024, 3, 9)),
        ("2024-03-10T03:00:00", "America/Argentina/Buenos_Aires", date(2024, 3, 10)),
        ("2024-03-10T22:59:59", "Europe/Madrid", date(2024, 3, 10)),
        ("2024-03-10T23:00:00", "Europe/Madrid", date(2024, 3, 11)),
        # Summer time: midnight comes an hour earlier.
        ("2024-07-10T22:00:00", "Europe/Madrid", date(2024, 7, 11)),
        ("2024-03-10T18:30:00", "Asia/Kolkata", date(2024, 3, 11)),
        ("2024-03-10T09:59:59", "Pacific/Kiritimati", date(2024, 3, 10)),
        ("2024-12-31T10:00:00", "Pacific/Kiritimati", date(2025, 1, 1)),
    ],
)
def test_today_is_the_local_day(monkeypatch, instant, zone, expected):
    class Clock(datetime):
        @classmethod
        def now(cls, tz=None):
            return datetime.fromisoformat(instant).replace(tzinfo=timezone.utc).astimezone(tz)

    monkeypatch.setattr(calendar, "datetime", Clock)
    assert calendar.today_in(zone) == expected
