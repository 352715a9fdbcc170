"""Report periods (pure Python; the dates become literals in the Spark plans).

``today`` is always an argument so that a report can be repeated exactly.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta


@dataclass(frozen=True)
class Period:
    """Inclusive date range ``[start, end]``. ``start > end`` is allowed and selects nothing."""

    start: date
    end: date

    @property
    def delta_days(self) -> int:
        return (self.end - self.start).days

    def __str__(self) -> str:
        return f"{self.start.isoformat()}..{self.end.isoformat()}"


def previous_month(today: date) -> Period:
    """The calendar month before the month of ``today``."""
    end = today.replace(day=1) - timedelta(days=1)
    return Period(end.replace(day=1), end)


def _parse(text: str | None) -> date | None:
    if not text:
        return None
    try:
        return datetime.strptime(text, "%Y-%m-%d").date()
    except ValueError:
        return None


def resolve_period(start: str | None, end: str | None, today: date) -> Period:
    """Both dates given and valid -> that range; otherwise the previous calendar month."""
    s, e = _parse(start), _parse(end)
    if s is None or e is None:
        return previous_month(today)
    return Period(s, e)


def trailing_year(today: date) -> Period:
    """366 days ending yesterday: ``[today - 366, today - 1]``."""
    end = today - timedelta(days=1)
    return Period(end - timedelta(days=365), end)


def last_12_months(today: date) -> Period:
    """``[today - 365, today]``: up to 13 calendar-month buckets, first and last partial."""
    return Period(today - timedelta(days=365), today)


@dataclass(frozen=True)
class Comparison:
    """Current period, previous period and the day shift that maps previous onto current."""

    current: Period
    previous: Period
    shift_days: int


def previous_period(period: Period, aligned: bool = False) -> Comparison:
    """Previous period of the same length, ending the day before ``period.start``.

    The reference moves previous-period days forward by ``end - start`` days, one day
    short of the true offset, so the moved window is ``[start - 1, end - 1]``. That is
    the default; ``aligned=True`` shifts by ``end - start + 1`` so day i meets day i.
    """
    delta = period.delta_days
    prev_end = period.start - timedelta(days=1)
    prev_start = prev_end - timedelta(days=delta)
    shift = delta + 1 if aligned else delta
    return Comparison(period, Period(prev_start, prev_end), shift)
