"""Overview page: twelve KPIs from three one-row aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.config import ReportConfig
from kpiloom.functions.measures import combine_single_rows, ratio
from kpiloom.operators.ads import known_campaign_totals
from kpiloom.operators.organic import purchase_totals, session_totals
from kpiloom.period import Period
from kpiloom.sources.tables import Tables


def _zero(c: str, typ: str = "double") -> Column:
    return F.coalesce(F.col(c), F.lit(0).cast(typ))


def marketing_overview(
    tables: Tables, period: Period, config: ReportConfig, null_policy: str = "zero"
) -> DataFrame:
    """One row of twelve KPIs (the reference cross-joins three one-row aggregates).

    ``null_policy='zero'`` (R1): every sum over no rows is 0. ``'keep'`` (V1, the
    un-imported variant): ads totals, sessions and users stay NULL, ROAS keeps the
    inner ``ELSE 0``, SEO sales and revenue are 0; ratios are 0 when undefined.
    "Conv. Rate" is conversions over *cost*, as in the reference.
    """
    ads = known_campaign_totals(
        tables.campaign_stats, tables.campaign_history, period, config.customer_id
    )
    ses = session_totals(tables.channel_session_report, period, config.channels)
    pur = purchase_totals(
        tables.channel_event_report, period, config.channels, config.purchase_event
    )
    # Three one-row aggregates combined by a union and one global aggregate (no join).
    row = combine_single_rows(ads, ses, pur)

    return row.select(*overview_columns(config, null_policy))


def overview_columns(config: ReportConfig, null_policy: str = "zero") -> list[Column]:
    """The twelve KPIs from one row with the columns of R1a, R1b and R1c."""
    if null_policy not in ("zero", "keep"):
        raise ValueError("null_policy must be 'zero' or 'keep'")
    keep = null_policy == "keep"

    def ads_col(c: str) -> Column:
        return F.col(c) if keep else _zero(c)

    cost, conv = ads_col("total_cost"), ads_col("total_conversions")
    sessions = F.col("total_ga4_sessions") if keep else _zero("total_ga4_sessions", "bigint")
    users = F.col("total_ga4_total_users") if keep else _zero("total_ga4_total_users", "bigint")
    sales = _zero("total_seo_sales", "bigint")
    roas = F.col("total_roas") if keep else _zero("total_roas")
    return [
        cost.alias("google_ads_total_cost"),
        conv.alias("google_ads_total_conversions"),
        ads_col("total_revenue").alias("google_ads_total_revenue"),
        roas.alias("google_ads_total_roas"),
        ratio(cost, conv).alias("cost_per_conversion"),
        ratio(conv, cost).alias("conv_rate"),
        sessions.alias("ga4_total_sessions"),
        users.alias("ga4_total_users"),
        sales.alias("total_seo_sales"),
        _zero("total_ga4_seo_revenue").alias("total_seo_revenue"),
        ratio(sales, sessions).alias("seo_conversion_rate"),
        ratio(F.lit(config.fixed_seo_cost), sales).alias("seo_cost_per_sale"),
    ]
