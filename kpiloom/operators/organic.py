"""Organic-traffic reports over the channel session / event reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.functions.measures import as_double, combine_single_rows
from kpiloom.operators.ads import in_period
from kpiloom.period import Period, last_12_months, previous_period

SESSION_CHANNEL = "session_default_channel_grouping"
EVENT_CHANNEL = "session_default_channel_group"

# Output names of the four event-report measures, in report order.
EVENT_MEASURES = ("ga4_sessions", "ga4_new_users", "ga4_total_revenue", "key_events")


def _organic(report: DataFrame, channel_col: str, channels, cond: Column) -> DataFrame:
    return report.where(cond & F.col(channel_col).isin(list(channels)))


def _event_sums(when: Column | None = None, suffix: str = "") -> list[Column]:
    """Sums of sessions, new users, revenue (exact decimal, output DOUBLE), event count."""

    def s(col: str) -> Column:
        c = F.col(col) if when is None else F.when(when, F.col(col))
        return F.sum(c)

    return [
        s("sessions").alias("ga4_sessions" + suffix),
        s("new_users").alias("ga4_new_users" + suffix),
        as_double(s("total_revenue")).alias("ga4_total_revenue" + suffix),
        s("event_count").alias("key_events" + suffix),
    ]


def session_totals(session_report: DataFrame, period: Period, channels) -> DataFrame:
    """Summed sessions and users (users are summed, not counted distinct). One row."""
    return _organic(session_report, SESSION_CHANNEL, channels, in_period(period)).agg(
        F.sum("sessions").alias("total_ga4_sessions"),
        F.sum("total_users").alias("total_ga4_total_users"),
    )


def purchase_totals(
    event_report: DataFrame, period: Period, channels, event: str = "purchase"
) -> DataFrame:
    """Purchase events and their revenue. One row."""
    cond = in_period(period) & (F.col("event_name") == F.lit(event))
    return _organic(event_report, EVENT_CHANNEL, channels, cond).agg(
        F.sum("event_count").alias("total_seo_sales"),
        as_double(F.sum("total_revenue")).alias("total_ga4_seo_revenue"),
    )


def organic_summary(
    session_report: DataFrame, event_report: DataFrame, period: Period, channels
) -> DataFrame:
    """Sessions from the session report (NULL when no rows), the rest from the
    event report (all events, 0 when no rows)."""
    sessions = _organic(session_report, SESSION_CHANNEL, channels, in_period(period)).agg(
        F.sum("sessions").alias("ga4_sessions")
    )
    events = _organic(event_report, EVENT_CHANNEL, channels, in_period(period)).agg(
        *_event_sums()[1:]
    )
    # Two one-row aggregates combined by a union and one global aggregate (no join).
    return combine_single_rows(sessions, events).select(
        "ga4_sessions",
        F.coalesce("ga4_new_users", F.lit(0).cast("bigint")).alias("ga4_new_users"),
        F.coalesce("ga4_total_revenue", F.lit(0.0)).alias("ga4_total_revenue"),
        F.coalesce("key_events", F.lit(0).cast("bigint")).alias("key_events"),
    )


def organic_daily_compare(
    event_report: DataFrame, period: Period, channels, aligned: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """Per-day measures of the period next to the previous period's, moved forward.

    Equivalent to the reference's full outer join of two per-day aggregates, planned
    as one scan of both ranges and one aggregate: every row belongs to at most one
    period (the ranges are disjoint), so it is keyed by its own date (current) or its
    moved date (previous) and summed conditionally. Missing sides are 0, like the
    reference's ``COALESCE``. ``aligned`` picks the one-day-longer shift (see
    ``previous_period``).
    """
    cmp = previous_period(period, aligned=aligned)
    cur = in_period(cmp.current)
    prev = in_period(cmp.previous)
    rows = _organic(event_report, EVENT_CHANNEL, channels, cur | prev).select(
        F.when(cur, F.col("date"))
        .otherwise(F.date_add(F.col("date"), cmp.shift_days))
        .alias("key_date"),
        cur.alias("_cur"),
        "sessions", "new_users", "total_revenue", "event_count",
    )
    daily = rows.groupBy(F.col("key_date").alias("date")).agg(
        *_event_sums(when=F.col("_cur")),
        *_event_sums(when=~F.col("_cur"), suffix="_previous_period"),
    )
    zero = {"ga4_total_revenue": F.lit(0.0)}
    out = [F.col("date")]
    for suffix in ("", "_previous_period"):
        for m in EVENT_MEASURES:
            name = m + suffix
            out.append(F.coalesce(F.col(name), zero.get(m, F.lit(0).cast("bigint"))).alias(name))
    result = daily.select(*out)
    return result.orderBy(F.col("date").asc_nulls_last()) if ordered else result


def organic_monthly(
    event_report: DataFrame, today: date, channels, ordered: bool = True
) -> DataFrame:
    """The four sums per calendar month of ``[today - 365, today]`` (up to 13)."""
    months = _organic(event_report, EVENT_CHANNEL, channels, in_period(last_12_months(today)))
    out = months.groupBy(F.trunc("date", "month").alias("month")).agg(*_event_sums())
    return out.orderBy(F.col("month").asc_nulls_last()) if ordered else out
