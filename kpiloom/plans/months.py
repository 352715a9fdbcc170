"""Long periods from whole months plus edge days.

A report over a year sums 366 days per campaign. Beside the daily rollup a monthly one holds the
same sums per calendar month, in the same schema, dated the first of the month. A period is then
its whole months, read from the monthly rollup, and the days before and after them: at most 12
monthly rows and 60 days per campaign for a year. The result is a drop-in ``campaign_stats`` (or
event report) for the reports of those periods, because all of them sum and none but the daily ones
looks at single days; both rollups can be partitioned by date, so only those folders are read.

With several periods (the KPI segments read two) a month counts as whole only if no period cuts it;
else its days are read, so each period still finds exactly its own rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.operators.organic import EVENT_CHANNEL
from kpiloom.period import Period
from kpiloom.plans.rollup import GRAIN, MEASURES
from kpiloom.sources.tables import conform

EVENT_GRAIN = ("date", EVENT_CHANNEL, "event_name")
EVENT_SUMS = ("sessions", "new_users", "event_count", "total_revenue")


@dataclass(frozen=True)
class Rollups:
    """The same sums per day and per month, in one schema."""

    daily: DataFrame
    monthly: DataFrame


def monthly(daily: DataFrame, table: str = "campaign_stats", grain: Sequence[str] = GRAIN, measures: Sequence[str] = MEASURES) -> DataFrame:
    """A daily rollup summed to months (``date`` is the first). Partial sums are combined before
    the shuffle. To refresh restated days, pass the days of their months and let
    ``write_rollup`` replace those months."""
    month = F.trunc("date", "month").alias("date")
    by = [month if c == "date" else F.col(c) for c in grain]
    return conform(daily.groupBy(*by).agg(*[F.sum(m).alias(m) for m in measures]), table)


def event_rollups(events: DataFrame) -> Rollups:
    """Daily and monthly rollups of an event report."""
    daily = conform(events.groupBy(*EVENT_GRAIN).agg(*[F.sum(m).alias(m) for m in EVENT_SUMS]), "channel_event_report")
    return Rollups(daily, monthly(daily, "channel_event_report", EVENT_GRAIN, EVENT_SUMS))


def _month_of(d: date) -> Period:
    first = d.replace(day=1)
    return Period(first, (first + timedelta(days=31)).replace(day=1) - timedelta(days=1))


def decompose(periods: Sequence[Period]) -> tuple[list[date], list[Period]]:
    """(first days of the whole months, ranges of the remaining days) of the union of the
    periods. Reversed periods hold nothing."""
    periods = [p for p in periods if p.start <= p.end]
    months: list[date] = []
    days: list[Period] = []
    if not periods:
        return months, days
    month = _month_of(min(p.start for p in periods))
    last = max(p.end for p in periods)
    while month.start <= last:
        parts = [Period(max(p.start, month.start), min(p.end, month.end)) for p in periods if p.start <= month.end and p.end >= month.start]
        if parts and all(part == month for part in parts):
            months.append(month.start)
        else:
            for part in sorted(parts, key=lambda x: x.start):
                if days and part.start <= days[-1].end + timedelta(days=1):
                    days[-1] = Period(days[-1].start, max(days[-1].end, part.end))
                else:
                    days.append(part)
        month = _month_of(month.end + timedelta(days=1))
    return months, days


def stats_over(rollups: Rollups, *periods: Period) -> DataFrame:
    """Rows for reports over these periods: monthly rows of whole months, daily rows of the rest.
    Reports of single days (``account_daily``, ``organic_daily_compare``) need the daily rollup."""
    months, days = decompose(periods)
    whole = rollups.monthly.where(F.col("date").isin(months)) if months else rollups.monthly.where("false")
    in_days = F.lit(False)
    for p in days:
        in_days |= F.col("date").between(F.lit(p.start), F.lit(p.end))
    return whole.unionByName(rollups.daily.where(in_days))
