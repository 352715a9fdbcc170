"""All KPI cards of the three pages from one scan of each table.

The overview, the ads segments and the SEO summary need overlapping sums. Each table is
read once: the stats are summed per campaign id for every period at once (``segment_sums``),
the two organic reports conditionally for both of their periods. The three one-row results
become one row, and every card is an expression over it.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.config import ReportConfig
from kpiloom.functions.measures import (
    SUM_CONVERSIONS, SUM_MICROS, SUM_VALUE, as_double, combine_single_rows, kpi_columns, money, ratio,
)
from kpiloom.operators import organic, present
from kpiloom.operators.ads import in_period
from kpiloom.operators.overview import overview_columns
from kpiloom.period import Period
from kpiloom.plans.segments import segment_sums
from kpiloom.sources.tables import Tables


def page_cards(
    tables: Tables, overview_period: Period, ads_period: Period, organic_period: Period,
    config: ReportConfig, today: date,
) -> DataFrame:
    """The cards of ``marketing_overview``, ``segment_totals`` and ``organic_summary``."""
    sums, segments = segment_sums(
        tables.campaign_stats, tables.campaign_history, ads_period, config, today, known_period=overview_period
    )
    over, seo = in_period(overview_period), in_period(organic_period)
    channels = list(config.channels)
    sessions = tables.channel_session_report.where((over | seo) & F.col(organic.SESSION_CHANNEL).isin(channels)).agg(
        F.sum(F.when(over, F.col("sessions"))).alias("total_ga4_sessions"),
        F.sum(F.when(over, F.col("total_users"))).alias("total_ga4_total_users"),
        F.sum(F.when(seo, F.col("sessions"))).alias("seo__ga4_sessions"),
    )
    bought = over & (F.col("event_name") == F.lit(config.purchase_event))
    events = tables.channel_event_report.where((bought | seo) & F.col(organic.EVENT_CHANNEL).isin(channels)).agg(
        F.sum(F.when(bought, F.col("event_count"))).alias("total_seo_sales"),
        as_double(F.sum(F.when(bought, F.col("total_revenue")))).alias("total_ga4_seo_revenue"),
        F.sum(F.when(seo, F.col("new_users"))).alias("seo__ga4_new_users"),
        as_double(F.sum(F.when(seo, F.col("total_revenue")))).alias("seo__ga4_total_revenue"),
        F.sum(F.when(seo, F.col("event_count"))).alias("seo__key_events"),
    )
    micros, conversions, value = (F.col(f"known__{n}") for n in (SUM_MICROS, SUM_CONVERSIONS, SUM_VALUE))
    row = combine_single_rows(sums, sessions, events).withColumns({
        "total_cost": money(micros),
        "total_conversions": as_double(conversions),
        "total_revenue": as_double(value),
        "total_roas": ratio(value, money(micros), guard=micros),
    })
    kpis = [c for s in segments if s != "known" for c in kpi_columns(True, prefix=f"{s}__")]
    summary = [
        F.col("seo__ga4_sessions"),
        *[F.coalesce(f"seo__{c}", F.lit(0)).alias(f"seo__{c}") for c in ("ga4_new_users", "ga4_total_revenue", "key_events")],
    ]
    return present.dashboard_cards(row.select(*overview_columns(config), *kpis, *summary))
