"""Presentation jobs re-aimed from the report templates.

They reshape already aggregated reports into long-form rows (KPI cards, chart
series) or filter / order a report table. All stay lazy Spark jobs: no report is
collected to be reshaped on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.functions.formatting import (
    day_label_sql,
    display_sql,
    month_label_sql,
    sql_str,
    title_label_sql,
)
from kpiloom.functions.ordering import By, with_position

# --- U1 metric cards ----------------------------------------------------------------


def metric_cards(
    df: DataFrame,
    page: str,
    section: str,
    keys: list[str],
    formats: dict[str, str],
    labels: dict[str, str] | None = None,
    section_sql: str | None = None,
) -> DataFrame:
    """Wide KPI rows -> one card row per (input row, key).

    ``value`` is the unscaled metric as DOUBLE; ``display`` applies the format kind
    (``percent`` shows value x 100). Labels default to ``replace('_',' ') | title``.
    ``section_sql`` (an SQL expression over the input row) overrides ``section``.
    """
    sec = section_sql or sql_str(section)
    return section_cards(df, page, [(sec, keys)], formats, labels)


def section_cards(
    df: DataFrame,
    page: str,
    sections: list[tuple[str, list[str]]],
    formats: dict[str, str],
    labels: dict[str, str] | None = None,
) -> DataFrame:
    """Cards of several sections (``(section SQL, keys)``) from one pass over ``df``:
    the input report is computed once however many sections show its columns."""
    cards = [c for sec, keys in sections for c in card_structs(page, sec, keys, formats, labels)]
    return df.selectExpr(f"inline(array({', '.join(cards)}))")


def card_structs(
    page: str, section_sql: str, keys: list[str], formats: dict[str, str],
    labels: dict[str, str] | None = None, prefix: str = "",
) -> list[str]:
    """SQL of one card per key; the value of ``key`` is in the column ``<prefix><key>``."""
    cards = []
    for i, key in enumerate(keys, start=1):
        label = sql_str(labels[key]) if labels and key in labels else title_label_sql(key)
        col = f"`{prefix}{key}`"
        cards.append(
            f"named_struct('page', {sql_str(page)}, 'section', {section_sql}, 'position', {i}, "
            f"'key', {sql_str(key)}, 'label', {label}, 'value', CAST({col} AS DOUBLE), "
            f"'display', {display_sql(col, formats[key])})"
        )
    return cards


# Card sections, keys, labels and formats of the three report pages.
OVERVIEW_LABELS = {
    "google_ads_total_cost": "Google Ads Total Cost",
    "google_ads_total_conversions": "Google Ads Total Conversions",
    "google_ads_total_revenue": "Google Ads Total Revenue",
    "google_ads_total_roas": "Google Ads Total ROAS",
    "cost_per_conversion": "Google Ads Cost / Conversion",
    "conv_rate": "Conv. Rate",
    "ga4_total_sessions": "GA4 Total Sessions",
    "ga4_total_users": "GA4 Total Users",
    "total_seo_sales": "Total SEO Sales",
    "total_seo_revenue": "Total GA4 SEO Revenue",
    "seo_conversion_rate": "Overall GA4 SEO Conversion Rate",
    "seo_cost_per_sale": "Overall SEO Cost Per Sale",
}
OVERVIEW_FORMATS = {
    "google_ads_total_cost": "currency",
    "google_ads_total_conversions": "decimal",
    "google_ads_total_revenue": "currency",
    "google_ads_total_roas": "multiple",
    "cost_per_conversion": "currency",
    "conv_rate": "percent",
    "ga4_total_sessions": "count",
    "ga4_total_users": "count",
    "total_seo_sales": "count",
    "total_seo_revenue": "currency",
    "seo_conversion_rate": "percent",
    "seo_cost_per_sale": "currency",
}
OVERVIEW_SECTIONS = (
    ("Total Monthly Performance Data (All Channels)", [
        "google_ads_total_cost", "google_ads_total_conversions",
        "google_ads_total_revenue", "google_ads_total_roas",
    ]),
    ("SEO Monthly Performance Data", [
        "ga4_total_sessions", "ga4_total_users", "total_seo_sales",
        "seo_conversion_rate", "total_seo_revenue", "seo_cost_per_sale",
    ]),
    ("Monthly AdWords Performance Data", [
        "google_ads_total_cost", "google_ads_total_conversions", "cost_per_conversion",
        "conv_rate", "google_ads_total_revenue", "google_ads_total_roas",
    ]),
)
ADS_CARD_KEYS = [
    "impressions", "clicks", "cpc", "cost", "conversion_cost",
    "conversions", "conversion_value", "roas",
]
ADS_FORMATS = {
    "impressions": "count",
    "clicks": "count",
    "cpc": "currency",
    "cost": "currency",
    "conversion_cost": "currency",
    "conversions": "count",
    "conversion_value": "currency",
    "roas": "multiple",
}
ADS_SECTIONS = {
    "account": "Monthly Performance Data - All Campaigns",
    "shopping": "Monthly Performance Data - Shopping Campaigns",
    "search": "Monthly Performance Data - Search",
    "trailing_year": "Yearly Performance Data",
}
SEO_SECTION = "Monthly Website Traffic"
SEO_CARD_KEYS = ["ga4_sessions", "ga4_new_users", "ga4_total_revenue", "key_events"]
SEO_LABELS = {
    "ga4_sessions": "Sessions",
    "ga4_new_users": "New Users",
    "ga4_total_revenue": "Total Revenue",
    "key_events": "Key Events",
}
SEO_FORMATS = {
    "ga4_sessions": "count",
    "ga4_new_users": "count",
    "ga4_total_revenue": "currency",
    "key_events": "count",
}


def _segment_section_sql(col: str) -> str:
    whens = " ".join(f"WHEN {sql_str(s)} THEN {sql_str(t)}" for s, t in ADS_SECTIONS.items())
    return f"CASE {col} {whens} END"


def dashboard_cards(row: DataFrame) -> DataFrame:
    """All KPI cards from one row: the overview KPIs by name, the KPIs of each ads segment as
    ``<segment>__<kpi>`` and the SEO summary as ``seo__<column>``."""
    cards = [c for t, k in OVERVIEW_SECTIONS for c in card_structs("overview", sql_str(t), k, OVERVIEW_FORMATS, OVERVIEW_LABELS)]
    for segment, title in ADS_SECTIONS.items():
        cards += card_structs("ads", sql_str(title), ADS_CARD_KEYS, ADS_FORMATS, prefix=f"{segment}__")
    cards += card_structs("seo", sql_str(SEO_SECTION), SEO_CARD_KEYS, SEO_FORMATS, SEO_LABELS, prefix="seo__")
    return row.selectExpr(f"inline(array({', '.join(cards)}))")


def overview_cards(overview: DataFrame) -> DataFrame:
    return section_cards(overview, "overview", [(sql_str(t), k) for t, k in OVERVIEW_SECTIONS],
                         OVERVIEW_FORMATS, OVERVIEW_LABELS)


def ads_cards(segments: DataFrame) -> DataFrame:
    return metric_cards(segments, "ads", "", ADS_CARD_KEYS, ADS_FORMATS,
                        section_sql=_segment_section_sql("segment"))


def seo_cards(seo: DataFrame) -> DataFrame:
    return metric_cards(seo, "seo", SEO_SECTION, SEO_CARD_KEYS, SEO_FORMATS, SEO_LABELS)


# --- U2 chart series ----------------------------------------------------------------

SERIES_COLUMNS = ("page", "chart", "series", "position", "x_label", "y")


def by_day(df: DataFrame, day: str) -> DataFrame:
    """``df`` plus the 1-based ``position`` of its row by ``day`` (NULL last). For reports with
    one row a day or month: their rows are bounded by the calendar, so one task numbers them."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(F.col(day).asc_nulls_last())).cast("bigint"))


def chart_points(
    df: DataFrame,
    page: str,
    x_label_sql: str,
    series: list[tuple[str, str, str]],
) -> DataFrame:
    """Numbered report rows -> (page, chart, series, position, x_label, y) points.

    All series of a report share its x order, so the rows are numbered once, before they are
    spread over the series. ``series`` lists ``(chart, series_label, measure_column)``;
    ``x_label_sql`` is the axis label.
    """
    points = [
        f"named_struct('page', {sql_str(page)}, 'chart', {sql_str(chart)}, "
        f"'series', {sql_str(label)}, 'position', position, "
        f"'x_label', {x_label_sql}, 'y', CAST(`{measure}` AS DOUBLE))"
        for chart, label, measure in series
    ]
    return df.selectExpr(f"inline(array({', '.join(points)}))").select(*SERIES_COLUMNS)


# Chart titles and dataset labels of the report pages.
ADS_DAILY_SERIES = [
    ("Daily Impressions", "Daily Impressions", "impressions"),
    ("Daily Clicks", "Daily Clicks", "clicks"),
    ("Daily Conversions", "Daily Conversions", "conversions"),
    ("Daily Cost Per Conversion", "Daily Cost Per Conversion", "cost_per_conversion"),
    ("Daily Conversion Value", "Daily Conversion Value", "conversion_value"),
]
CAMPAIGN_SERIES = [("Conversions By Campaign", "Conversions By Campaign", "conversions")]
SEO_DAILY_SERIES = [
    ("Daily Key Events", "Daily Key Events", "key_events"),
    ("Daily Key Events", "Daily Key Events (Previous Period)", "key_events_previous_period"),
    ("Daily Total Revenue", "Daily Total Revenue", "ga4_total_revenue"),
    ("Daily Total Revenue", "Daily Total Revenue (Previous Period)",
     "ga4_total_revenue_previous_period"),
]
SEO_MONTHLY_SERIES = [
    ("Monthly Sessions", "Monthly Sessions", "ga4_sessions"),
    ("Monthly Key Events", "Monthly Key Events", "key_events"),
    ("Monthly New Users", "Monthly New Users", "ga4_new_users"),
    ("Monthly Total Revenue", "Monthly Total Revenue", "ga4_total_revenue"),
]


def ads_series(daily: DataFrame, by_campaign: DataFrame) -> DataFrame:
    """Chart series of the ads page (R6, R7). Campaign names are not bounded, so they are
    numbered in ordered buckets (``with_position``)."""
    campaigns = with_position(by_campaign, [F.col("campaign")])
    return chart_points(by_day(daily, "day"), "ads", day_label_sql("day"), ADS_DAILY_SERIES).unionByName(
        chart_points(campaigns, "ads", "campaign", CAMPAIGN_SERIES)
    )


def seo_series(seo_daily: DataFrame, monthly: DataFrame) -> DataFrame:
    """Chart series of the SEO page."""
    return chart_points(by_day(seo_daily, "date"), "seo", day_label_sql("date"), SEO_DAILY_SERIES).unionByName(
        chart_points(by_day(monthly, "month"), "seo", month_label_sql("month"), SEO_MONTHLY_SERIES)
    )


def dashboard_series(
    daily: DataFrame, by_campaign: DataFrame, seo_daily: DataFrame, monthly: DataFrame
) -> DataFrame:
    """All chart series of both pages."""
    return ads_series(daily, by_campaign).unionByName(seo_series(seo_daily, monthly))


# --- tables of the ads page ------------------------------------------------------------

# Cell formats of the two tables of the ads page, by position.
TABLE_FORMATS = ("currency", "decimal", "percent", "currency", "currency", "multiple")


def report_table(df: DataFrame) -> DataFrame:
    """A campaign or product report with the text of each cell beside its value: the first
    column is text, ``<measure>_text`` shows the measures after it (NULL: empty)."""
    measures = df.columns[1:]
    texts = [f"{display_sql(f'`{c}`', kind)} AS `{c}_text`" for c, kind in zip(measures, TABLE_FORMATS, strict=True)]
    return df.selectExpr("*", *texts)


# --- U3 product search --------------------------------------------------------------

def product_search(df: DataFrame, query: str, column: str = "product_title") -> DataFrame:
    """Rows whose ``column`` contains ``query`` ignoring case; literal text (``%`` and
    ``_`` are not wildcards); an empty query keeps every row. A NULL title matches
    only the empty query (it has no text to search)."""
    if not query:
        return df
    return df.where(F.upper(F.col(column)).contains(F.upper(F.lit(query))))


# --- U4 sort ------------------------------------------------------------------------

def next_sort(prev_column: str | None, prev_ascending: bool | None, column: str) -> bool:
    """Direction after a click on ``column``: ascending first, toggled on a repeat click."""
    if prev_column == column and prev_ascending is not None:
        return not prev_ascending
    return True


def sort_report(
    df: DataFrame, column: str, ascending: bool = True, key: str | None = None
) -> DataFrame:
    """Sort a report table by any column and number the rows (``position``).

    Text columns compare lower-cased (then exact, for a total order); numbers by
    value, unrounded. NULLs go last either way. Ties break on the report's first
    column (its key), ascending.
    """
    key = key or df.columns[0]
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.StringType):
        primary = [F.lower(F.col(column)), F.col(column)]
    else:
        primary = [F.col(column)]
    order = [By(c, ascending) for c in primary]
    if key != column:
        order.append(By(F.col(key)))
    return with_position(df, order)
