"""Registered queries: every report over the driver's tables with the FIXTURES parameters.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the whole
tables at ``sf_dir`` (bindings in ``kpiloom.sources.bindings``).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.config import ReportConfig
from kpiloom.operators import ads, dims, organic, overview, present
from kpiloom.period import Period, last_12_months, trailing_year
from kpiloom.plans import cards, latest_state, months, segments
from kpiloom.plans.rollup import daily_rollup
from kpiloom.sources.bindings import bind_tables
from kpiloom.sources.files import scratch_folder
from kpiloom.sources.tables import MONEY
from kpiloom.streaming import rollup_stream

# Test parameters (FIXTURES.md, "Fixed parameters for the oracle queries").
CONFIG = ReportConfig(
    customer_id="O",
    channels=("Organic Search", "Organic Shopping"),
    shopping_pattern="%URGENT%",
    excluded_patterns=("%HIGH%", "%LOW%"),
    fixed_seo_cost=2050.0,
    purchase_event="purchase",
)
ADS_PERIOD = Period(date(1998, 1, 1), date(1998, 1, 31))
ADS_TODAY = date(1999, 1, 2)  # trailing year 1998-01-01 .. 1999-01-01
ORGANIC_PERIOD = Period(date(2024, 1, 16), date(2024, 1, 30))
MONTHLY_TODAY = date(1999, 3, 10)  # 1998-03-10 .. 1999-03-10 on the long binding
# The overview spans the ads facts (1995-2001) and the events (January 2024).
OVERVIEW_PERIOD = Period(date(1998, 1, 1), date(2024, 1, 30))
PRODUCT_QUERY = "Bolt"
SORT_COLUMN, SORT_ASCENDING = "conversion_rate", False

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark, sf_dir):
    return bind_tables(spark, sf_dir)


def q_known_campaign_totals(spark, sf_dir):
    t = _t(spark, sf_dir)
    return ads.known_campaign_totals(
        t.campaign_stats, t.campaign_history, ADS_PERIOD, CONFIG.customer_id
    )


def q_session_totals(spark, sf_dir):
    t = _t(spark, sf_dir)
    return organic.session_totals(t.channel_session_report, ORGANIC_PERIOD, CONFIG.channels)


def q_purchase_totals(spark, sf_dir):
    t = _t(spark, sf_dir)
    return organic.purchase_totals(
        t.channel_event_report, ORGANIC_PERIOD, CONFIG.channels, CONFIG.purchase_event
    )


def q_marketing_overview(spark, sf_dir):
    return overview.marketing_overview(_t(spark, sf_dir), OVERVIEW_PERIOD, CONFIG)


def q_marketing_overview_nullable(spark, sf_dir):
    return overview.marketing_overview(
        _t(spark, sf_dir), OVERVIEW_PERIOD, CONFIG, null_policy="keep"
    )


def q_account_totals(spark, sf_dir):
    t = _t(spark, sf_dir)
    return ads.account_totals(t.campaign_stats, ADS_PERIOD, CONFIG.customer_id)


def q_shopping_totals(spark, sf_dir):
    t = _t(spark, sf_dir)
    return ads.shopping_totals(
        t.campaign_stats, t.campaign_history, ADS_PERIOD, CONFIG.customer_id,
        CONFIG.shopping_pattern,
    )


def q_search_totals(spark, sf_dir):
    t = _t(spark, sf_dir)
    return ads.search_totals(
        t.campaign_stats, t.campaign_history, ADS_PERIOD, CONFIG.customer_id,
        CONFIG.shopping_pattern,
    )


def q_trailing_year_totals(spark, sf_dir):
    t = _t(spark, sf_dir)
    return ads.trailing_year_totals(
        t.campaign_stats, t.campaign_history, ADS_TODAY, CONFIG.customer_id,
        CONFIG.excluded_patterns,
    )


def q_account_daily(spark, sf_dir):
    t = _t(spark, sf_dir)
    return ads.account_daily(t.campaign_stats, ADS_PERIOD, CONFIG.customer_id)


def q_conversions_by_campaign_version(spark, sf_dir):
    t = _t(spark, sf_dir)
    return ads.conversions_by_campaign_version(
        t.campaign_stats, t.campaign_history, ADS_PERIOD, CONFIG.customer_id
    )


def q_campaign_performance(spark, sf_dir):
    t = _t(spark, sf_dir)
    return ads.campaign_performance(
        t.campaign_stats, t.campaign_history, ADS_PERIOD, CONFIG.customer_id
    )


def q_product_performance(spark, sf_dir):
    t = _t(spark, sf_dir)
    return ads.product_performance(t.products, ADS_PERIOD, CONFIG.customer_id)


def q_organic_summary(spark, sf_dir):
    t = _t(spark, sf_dir)
    return organic.organic_summary(
        t.channel_session_report, t.channel_event_report, ORGANIC_PERIOD, CONFIG.channels
    )


def q_organic_daily_compare(spark, sf_dir):
    t = _t(spark, sf_dir)
    return organic.organic_daily_compare(t.channel_event_report, ORGANIC_PERIOD, CONFIG.channels)


def q_organic_daily_compare_aligned(spark, sf_dir):
    t = _t(spark, sf_dir)
    return organic.organic_daily_compare(
        t.channel_event_report, ORGANIC_PERIOD, CONFIG.channels, aligned=True
    )


def _long_report(spark, sf_dir):
    return _t(spark, sf_dir).channel_event_report_long


def q_organic_monthly(spark, sf_dir):
    return organic.organic_monthly(_long_report(spark, sf_dir), MONTHLY_TODAY, CONFIG.channels)


def q_latest_campaign(spark, sf_dir):
    return dims.latest_campaign(_t(spark, sf_dir).campaign_history)


def q_segment_totals(spark, sf_dir):
    t = _t(spark, sf_dir)
    return segments.segment_totals(
        t.campaign_stats, t.campaign_history, ADS_PERIOD, CONFIG, today=ADS_TODAY
    )


def q_metric_cards(spark, sf_dir):
    """Every KPI card of the three pages, long form."""
    t = _t(spark, sf_dir)
    return cards.page_cards(t, OVERVIEW_PERIOD, ADS_PERIOD, ORGANIC_PERIOD, CONFIG, ADS_TODAY)


def q_chart_series(spark, sf_dir):
    """Every chart series of the ads and SEO pages, long form."""
    t = _t(spark, sf_dir)
    # The series are positioned by their own sort: the reports' global sorts are skipped.
    daily = ads.account_daily(t.campaign_stats, ADS_PERIOD, CONFIG.customer_id, ordered=False)
    by_campaign = ads.conversions_by_campaign_version(
        t.campaign_stats, t.campaign_history, ADS_PERIOD, CONFIG.customer_id, ordered=False
    )
    seo_daily = organic.organic_daily_compare(
        t.channel_event_report, ORGANIC_PERIOD, CONFIG.channels, ordered=False
    )
    monthly = organic.organic_monthly(
        _long_report(spark, sf_dir), MONTHLY_TODAY, CONFIG.channels, ordered=False
    )
    return present.dashboard_series(daily, by_campaign, seo_daily, monthly)


def q_product_search(spark, sf_dir):
    return present.product_search(q_product_performance(spark, sf_dir), PRODUCT_QUERY)


def q_sort_report(spark, sf_dir):
    t = _t(spark, sf_dir)
    perf = ads.campaign_performance(
        t.campaign_stats, t.campaign_history, ADS_PERIOD, CONFIG.customer_id, ordered=False
    )
    return present.sort_report(perf, SORT_COLUMN, ascending=SORT_ASCENDING)


def q_campaign_table(spark, sf_dir):
    """The campaign table of the ads page with its cell texts."""
    return present.report_table(q_campaign_performance(spark, sf_dir))


def q_product_table(spark, sf_dir):
    """The product table of the ads page with its cell texts."""
    return present.report_table(q_product_performance(spark, sf_dir))


def q_sort_products(spark, sf_dir):
    """The searched product table by conversions, as a click on the column sorts it."""
    t = _t(spark, sf_dir)
    perf = ads.product_performance(t.products, ADS_PERIOD, CONFIG.customer_id, ordered=False)
    found = present.product_search(perf, PRODUCT_QUERY)
    return present.sort_report(found, "conversions", ascending=present.next_sort(None, None, "conversions"))


def q_sort_products_by_title(spark, sf_dir):
    """The product table by title, ascending, without regard to case."""
    t = _t(spark, sf_dir)
    perf = ads.product_performance(t.products, ADS_PERIOD, CONFIG.customer_id, ordered=False)
    return present.sort_report(perf, "product_title", ascending=True)


# --- reports from maintained tables: the whole inputs, through the stored form ------------

def q_latest_campaign_maintained(spark, sf_dir):
    """The latest versions after the history has arrived in four parts, one of them twice and the
    newest first, merged into a stored state."""
    history = _t(spark, sf_dir).campaign_history
    root = scratch_folder(spark, "latest")
    year = F.year("start_date")
    for part in (year >= 1997, year < 1995, year.isNull() | year.between(1995, 1996), year < 1995):
        latest_state.merge_latest(spark, root, history.where(part), buckets=16)
    return latest_state.read_latest(spark, root)


def q_account_daily_restated(spark, sf_dir):
    """The daily report from statements that replace each other: preliminary days, then the final
    ones, then a preliminary statement that arrives late."""
    stats = _t(spark, sf_dir).campaign_stats
    first = stats.withColumns({"clicks": F.col("clicks") + 1, "conversions": (F.col("conversions") * 2).cast(MONEY)})
    root = scratch_folder(spark, "restated")
    write = rollup_stream.batch_writer(root, restated=True, stamp="stated")
    write(first.withColumn("stated", F.lit(1).cast("bigint")), 0)
    write(stats.withColumn("stated", F.lit(2).cast("bigint")), 1)
    write(first.where(F.dayofmonth("date") <= 9).withColumn("stated", F.lit(1).cast("bigint")), 2)
    return ads.account_daily(rollup_stream.read_stream_rollup(spark, root, restated=True), ADS_PERIOD, CONFIG.customer_id)


def _stored(spark, name: str, rollups: months.Rollups) -> months.Rollups:
    """Daily and monthly rollups as written tables."""
    def written(df):
        path = scratch_folder(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    daily = written(rollups.daily)
    return months.Rollups(daily, written(rollups.monthly))


def _campaign_rollups(spark, t) -> months.Rollups:
    daily = daily_rollup(t.campaign_stats)
    return _stored(spark, "rollup", months.Rollups(daily, months.monthly(daily)))


def q_trailing_year_by_months(spark, sf_dir):
    """R5 from twelve monthly rows and the edge days of each campaign."""
    t = _t(spark, sf_dir)
    stats = months.stats_over(_campaign_rollups(spark, t), trailing_year(ADS_TODAY))
    return ads.trailing_year_totals(stats, t.campaign_history, ADS_TODAY, CONFIG.customer_id, CONFIG.excluded_patterns)


def q_segment_totals_by_months(spark, sf_dir):
    """U5 over two periods from months that neither of them cuts, and days."""
    t = _t(spark, sf_dir)
    stats = months.stats_over(_campaign_rollups(spark, t), ADS_PERIOD, trailing_year(ADS_TODAY))
    return segments.segment_totals(stats, t.campaign_history, ADS_PERIOD, CONFIG, today=ADS_TODAY)


def q_organic_monthly_by_months(spark, sf_dir):
    """R12 from the monthly rollup of the event report; only the two edge months are read by day."""
    rollups = _stored(spark, "events", months.event_rollups(_long_report(spark, sf_dir)))
    events = months.stats_over(rollups, last_12_months(MONTHLY_TODAY))
    return organic.organic_monthly(events, MONTHLY_TODAY, CONFIG.channels)


#: Queries that first store what they read; the bench times them apart.
MAINTAINED: dict[str, Query] = {
    "latest_campaign_maintained": q_latest_campaign_maintained,
    "account_daily_restated": q_account_daily_restated,
    "trailing_year_by_months": q_trailing_year_by_months,
    "segment_totals_by_months": q_segment_totals_by_months,
    "organic_monthly_by_months": q_organic_monthly_by_months,
}
QUERIES: dict[str, Query] = {
    "known_campaign_totals": q_known_campaign_totals,
    "session_totals": q_session_totals,
    "purchase_totals": q_purchase_totals,
    "marketing_overview": q_marketing_overview,
    "marketing_overview_nullable": q_marketing_overview_nullable,
    "account_totals": q_account_totals,
    "shopping_totals": q_shopping_totals,
    "search_totals": q_search_totals,
    "trailing_year_totals": q_trailing_year_totals,
    "account_daily": q_account_daily,
    "conversions_by_campaign_version": q_conversions_by_campaign_version,
    "campaign_performance": q_campaign_performance,
    "product_performance": q_product_performance,
    "organic_summary": q_organic_summary,
    "organic_daily_compare": q_organic_daily_compare,
    "organic_daily_compare_aligned": q_organic_daily_compare_aligned,
    "organic_monthly": q_organic_monthly,
    "latest_campaign": q_latest_campaign,
    "segment_totals": q_segment_totals,
    "metric_cards": q_metric_cards,
    "chart_series": q_chart_series,
    "product_search": q_product_search,
    "sort_report": q_sort_report,
    "campaign_table": q_campaign_table,
    "product_table": q_product_table,
    "sort_products": q_sort_products,
    "sort_products_by_title": q_sort_products_by_title,
    **MAINTAINED,
}
