"""Report filters, read once from text and typed from then on."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date

from boardpulse.functions.calendar import Period

# Accepted spellings of each filter, the first one wins.
SPELLINGS = {
    "start_date": ("start_date", "from"),
    "end_date": ("end_date", "to"),
    "position_id": ("position_id", "positionId"),
    "dashboard_name": ("dashboard_name", "dashboardName"),
    "user_id": ("user_id", "userId"),
}


@dataclass(frozen=True)
class ReportParams:
    """Filters of a usage report; None means not set."""

    start_date: date | None = None
    end_date: date | None = None
    position_id: int | None = None
    dashboard_name: str | None = None
    user_id: int | None = None
    exclude_admins: bool = False

    @classmethod
    def from_query(cls, query: Mapping[str, str | None]) -> ReportParams:
        """Parse query-string style filters; empty text counts as absent.

        An id that is no number is refused. Admins are left out only on the text 'true'.
        """
        text = {
            name: next((query[spelling] for spelling in spellings if query.get(spelling)), None)
            for name, spellings in SPELLINGS.items()
        }
        return cls(
            start_date=_day("start_date", text["start_date"]),
            end_date=_day("end_date", text["end_date"]),
            position_id=_number("position_id", text["position_id"]),
            dashboard_name=text["dashboard_name"],
            user_id=_number("user_id", text["user_id"]),
            exclude_admins=query.get("exclude_admins") == "true",
        )

    def period(self, as_of: date) -> Period:
        return Period.resolve(self.start_date, self.end_date, as_of)


def _number(name: str, text: str | None) -> int | None:
    if text is None:
        return None
    try:
        return int(text)
    except ValueError:
        raise ValueError(f"{name} must be a whole number, not {text!r}") from None


def _day(name: str, text: str | None) -> date | None:
    if text is None:
        return None
    try:
        return date.fromisoformat(text)
    except ValueError:
        raise ValueError(f"{name} must be a date like 2024-01-31, not {text!r}") from None
