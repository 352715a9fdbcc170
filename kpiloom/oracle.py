"""DuckDB oracle SQL for every registered query.

Plain row-level statements (joins on rows, ``ROW_NUMBER`` dedup, one statement per
segment) over the FIXTURES bindings of the raw tables, with their own dates and labels, so
agreement with the Spark plans (which pre-aggregate and share scans) checks those. Outputs are cast
like the Spark side: counts BIGINT, money and ratios DOUBLE computed with the same
floating-point operations, dates DATE.
"""

from __future__ import annotations

from datetime import date
from typing import NamedTuple

from kpiloom.config import ReportConfig


class Range(NamedTuple):
    start: date
    end: date


# The FIXTURES parameters, dates and labels, stated here on their own so that a
# wrong window or label in the library shows.
CONFIG = ReportConfig(
    customer_id="O", channels=("Organic Search", "Organic Shopping"), shopping_pattern="%URGENT%",
    excluded_patterns=("%HIGH%", "%LOW%"), fixed_seo_cost=2050.0, purchase_event="purchase",
)
ADS_PERIOD = Range(date(1998, 1, 1), date(1998, 1, 31))
TRAILING_YEAR = Range(date(1998, 1, 1), date(1999, 1, 1))
ORGANIC_PERIOD = Range(date(2024, 1, 16), date(2024, 1, 30))
PREVIOUS_PERIOD = Range(date(2024, 1, 1), date(2024, 1, 15))  # moved by 14 days, or by 15 when aligned
TWELVE_MONTHS = Range(date(1998, 3, 10), date(1999, 3, 10))
OVERVIEW_PERIOD = Range(date(1998, 1, 1), date(2024, 1, 30))
PRODUCT_QUERY = "Bolt"
# (section, ((column, label, format), ...)) of the overview page.
_ADS_COST = ("google_ads_total_cost", "Google Ads Total Cost", "currency")
_ADS_CONV = ("google_ads_total_conversions", "Google Ads Total Conversions", "decimal")
_ADS_REV = ("google_ads_total_revenue", "Google Ads Total Revenue", "currency")
_ADS_ROAS = ("google_ads_total_roas", "Google Ads Total ROAS", "multiple")
OVERVIEW_CARDS = (
    ("Total Monthly Performance Data (All Channels)", (_ADS_COST, _ADS_CONV, _ADS_REV, _ADS_ROAS)),
    ("SEO Monthly Performance Data", (
        ("ga4_total_sessions", "GA4 Total Sessions", "count"), ("ga4_total_users", "GA4 Total Users", "count"),
        ("total_seo_sales", "Total SEO Sales", "count"),
        ("seo_conversion_rate", "Overall GA4 SEO Conversion Rate", "percent"),
        ("total_seo_revenue", "Total GA4 SEO Revenue", "currency"),
        ("seo_cost_per_sale", "Overall SEO Cost Per Sale", "currency"),
    )),
    ("Monthly AdWords Performance Data", (
        _ADS_COST, _ADS_CONV, ("cost_per_conversion", "Google Ads Cost / Conversion", "currency"),
        ("conv_rate", "Conv. Rate", "percent"), _ADS_REV, _ADS_ROAS,
    )),
)
ADS_CARDS = (
    ("impressions", "Impressions", "count"), ("clicks", "Clicks", "count"), ("cpc", "Cpc", "currency"), ("cost", "Cost", "currency"),
    ("conversion_cost", "Conversion Cost", "currency"), ("conversions", "Conversions", "count"),
    ("conversion_value", "Conversion Value", "currency"), ("roas", "Roas", "multiple"),
)
ADS_SECTIONS = {
    "account": "Monthly Performance Data - All Campaigns", "shopping": "Monthly Performance Data - Shopping Campaigns",
    "search": "Monthly Performance Data - Search", "trailing_year": "Yearly Performance Data",
}
SEO_CARDS = (
    ("ga4_sessions", "Sessions", "count"), ("ga4_new_users", "New Users", "count"),
    ("ga4_total_revenue", "Total Revenue", "currency"), ("key_events", "Key Events", "count"),
)
# (chart, series, measure)
ADS_DAILY_SERIES = (
    ("Daily Impressions", "Daily Impressions", "impressions"), ("Daily Clicks", "Daily Clicks", "clicks"),
    ("Daily Conversions", "Daily Conversions", "conversions"),
    ("Daily Cost Per Conversion", "Daily Cost Per Conversion", "cost_per_conversion"),
    ("Daily Conversion Value", "Daily Conversion Value", "conversion_value"),
)
CAMPAIGN_SERIES = (("Conversions By Campaign", "Conversions By Campaign", "conversions"),)
SEO_DAILY_SERIES = (
    ("Daily Key Events", "Daily Key Events", "key_events"),
    ("Daily Key Events", "Daily Key Events (Previous Period)", "key_events_previous_period"),
    ("Daily Total Revenue", "Daily Total Revenue", "ga4_total_revenue"),
    ("Daily Total Revenue", "Daily Total Revenue (Previous Period)", "ga4_total_revenue_previous_period"),
)
SEO_MONTHLY_SERIES = (
    ("Monthly Sessions", "Monthly Sessions", "ga4_sessions"), ("Monthly Key Events", "Monthly Key Events", "key_events"),
    ("Monthly New Users", "Monthly New Users", "ga4_new_users"), ("Monthly Total Revenue", "Monthly Total Revenue", "ga4_total_revenue"),
)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _d(d) -> str:
    return f"DATE '{d.isoformat()}'"


def _channel(key: str) -> str:
    return (
        f"CASE {key} % 4 WHEN 0 THEN 'Organic Search' WHEN 1 THEN 'Organic Shopping' "
        f"WHEN 2 THEN 'Direct' WHEN 3 THEN 'Paid Search' END"
    )


BINDINGS = {
    "campaign_stats": """campaign_stats AS (
    SELECT l.l_linestatus AS customer_id, l.l_partkey AS id, CAST(l.l_shipdate AS DATE) AS date,
           CAST(l.l_quantity AS BIGINT) * 100 AS impressions, CAST(l.l_quantity AS BIGINT) AS clicks,
           CAST(ROUND(l.l_extendedprice * 100) AS BIGINT) * 10000 AS cost_micros,
           CAST(l.l_discount AS DECIMAL(18,2)) AS conversions,
           CAST(CAST(l.l_extendedprice AS DECIMAL(16,2)) * l.l_linenumber AS DECIMAL(18,2)) AS conversions_value
    FROM lineitem l)""",
    "campaign_history": """campaign_history AS (
    SELECT o_custkey AS id, o_orderpriority AS name, CAST(o_orderdate AS DATE) AS start_date,
           o_orderkey AS version_id
    FROM orders)""",
    "latest": """latest AS (
    SELECT id, name FROM (
        SELECT id, name, ROW_NUMBER() OVER (PARTITION BY id
            ORDER BY start_date DESC NULLS FIRST, version_id DESC NULLS LAST, name ASC NULLS LAST) AS rn
        FROM campaign_history) WHERE rn = 1)""",
    "product_stats": """product_stats AS (
    SELECT l.l_linestatus AS customer_id, p.p_name AS product_title, CAST(l.l_shipdate AS DATE) AS date,
           CAST(l.l_quantity AS BIGINT) AS clicks,
           CAST(ROUND(l.l_extendedprice * 100) AS BIGINT) * 10000 AS cost_micros,
           CAST(l.l_discount AS DECIMAL(18,2)) AS conversions,
           CAST(p.p_retailprice AS DECIMAL(18,2)) AS conversions_value
    FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)""",
    "channel_event_report": f"""channel_event_report AS (
    SELECT CAST(ts AS DATE) AS date, {_channel('user_id')} AS session_default_channel_group,
           event_type AS event_name, CAST(1 AS BIGINT) AS sessions,
           CAST(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS BIGINT) AS new_users,
           CAST(1 AS BIGINT) AS event_count, CAST(value AS DECIMAL(18,2)) AS total_revenue
    FROM events)""",
    "channel_session_report": f"""channel_session_report AS (
    SELECT CAST(ts AS DATE) AS date, {_channel('user_id')} AS session_default_channel_grouping,
           COUNT(*) AS sessions, COUNT(DISTINCT user_id) AS total_users
    FROM events GROUP BY 1, 2)""",
    "channel_event_report_long": f"""channel_event_report_long AS (
    SELECT CAST(l_shipdate AS DATE) AS date, {_channel('l_linenumber')} AS session_default_channel_group,
           CAST(l_quantity AS BIGINT) AS sessions, CAST(l_linenumber AS BIGINT) AS new_users,
           CAST(1 AS BIGINT) AS event_count, CAST(l_extendedprice AS DECIMAL(18,2)) AS total_revenue
    FROM lineitem)""",
}


class Stmt:
    """A statement as (named CTEs it needs, final SELECT); composable without parsing."""

    def __init__(self, ctes: list[str], select: str):
        self.ctes = ctes
        self.select = select

    def sql(self) -> str:
        return render(self.ctes, self.select)

    def as_cte(self, name: str) -> list[str]:
        return self.ctes + [f"{name} AS (\n{self.select})"]


def needs(*names: str) -> list[str]:
    return [BINDINGS[n] for n in names]


def render(ctes: list[str], select: str) -> str:
    seen, uniq = set(), []
    for c in ctes:
        if c not in seen:
            seen.add(c)
            uniq.append(c)
    return ("WITH " + ",\n".join(uniq) + "\n" if uniq else "") + select


COST = "(CAST(SUM(cs.cost_micros) AS DOUBLE) / 1000000.0)"
CONV = "CAST(SUM(cs.conversions) AS DOUBLE)"
VALUE = "CAST(SUM(cs.conversions_value) AS DOUBLE)"
CLICKS = "CAST(SUM(cs.clicks) AS DOUBLE)"
IMPR = "CAST(SUM(cs.impressions) AS DOUBLE)"


def _guard(cond: str, expr: str) -> str:
    return f"CASE WHEN {cond} > 0 THEN {expr} ELSE 0.0 END"


def _kpis() -> str:
    """The ten account KPIs, NULL -> 0 (the reference's post-processing)."""
    cols = [
        ("CAST(COALESCE(SUM(cs.impressions), 0) AS BIGINT)", "impressions"),
        ("CAST(COALESCE(SUM(cs.clicks), 0) AS BIGINT)", "clicks"),
        (f"COALESCE({_guard('SUM(cs.clicks)', f'{COST} / {CLICKS}')}, 0.0)", "cpc"),
        (f"COALESCE({COST}, 0.0)", "cost"),
        (f"COALESCE({_guard('SUM(cs.conversions)', f'{COST} / {CONV}')}, 0.0)", "conversion_cost"),
        (f"COALESCE({CONV}, 0.0)", "conversions"),
        (f"COALESCE({VALUE}, 0.0)", "conversion_value"),
        (f"COALESCE({_guard('SUM(cs.cost_micros)', f'{VALUE} / {COST}')}, 0.0)", "roas"),
        (f"COALESCE({_guard('SUM(cs.impressions)', f'{CLICKS} / {IMPR}')}, 0.0)", "ctr"),
        (f"COALESCE({_guard('SUM(cs.clicks)', f'{CONV} / {CLICKS}')}, 0.0)", "conv_rate"),
    ]
    return ",\n       ".join(f"{e} AS {n}" for e, n in cols)


def _perf(value_name: str, value_cost_name: str) -> str:
    cols = [
        (COST, "cost"),
        (CONV, "conversions"),
        (_guard("SUM(cs.clicks)", f"{CONV} / {CLICKS}"), "conversion_rate"),
        (_guard("SUM(cs.conversions)", f"{COST} / {CONV}"), "cost_per_conversion"),
        (VALUE, value_name),
        (_guard("SUM(cs.cost_micros)", f"{VALUE} / {COST}"), value_cost_name),
    ]
    return ",\n       ".join(f"{e} AS {n}" for e, n in cols)


def _where(period, alias: str = "cs") -> str:
    return (
        f"{alias}.customer_id = {_q(CONFIG.customer_id)} "
        f"AND {alias}.date BETWEEN {_d(period.start)} AND {_d(period.end)}"
    )


def _channels() -> str:
    return "(" + ", ".join(_q(c) for c in CONFIG.channels) + ")"


def _not_like(patterns) -> str:
    return " AND ".join(f"ch.name NOT LIKE {_q(p)}" for p in patterns)


# --- ads ------------------------------------------------------------------------------

STATS_LATEST = ("campaign_stats", "campaign_history", "latest")


def account_totals(period=ADS_PERIOD, label: str | None = None) -> Stmt:
    seg = f"{_q(label)} AS segment, " if label else ""
    return Stmt(needs("campaign_stats"),
                f"SELECT {seg}{_kpis()}\nFROM campaign_stats cs WHERE {_where(period)}")


def named_totals(period, name_cond: str, label: str | None = None) -> Stmt:
    seg = f"{_q(label)} AS segment, " if label else ""
    return Stmt(needs(*STATS_LATEST), (
        f"SELECT {seg}{_kpis()}\nFROM campaign_stats cs JOIN latest ch ON cs.id = ch.id\n"
        f"WHERE {_where(period)} AND {name_cond}"
    ))


def known_campaign_totals(period=ADS_PERIOD) -> Stmt:
    return Stmt(needs(*STATS_LATEST), f"""SELECT {COST} AS total_cost, {CONV} AS total_conversions,
       {VALUE} AS total_revenue, {_guard('SUM(cs.cost_micros)', f'{VALUE} / {COST}')} AS total_roas
FROM campaign_stats cs JOIN latest ch ON cs.id = ch.id
WHERE {_where(period)}""")


def account_daily() -> Stmt:
    return Stmt(needs("campaign_stats"), f"""SELECT cs.date AS day,
       CAST(SUM(cs.impressions) AS BIGINT) AS impressions, CAST(SUM(cs.clicks) AS BIGINT) AS clicks,
       {CONV} AS conversions,
       {_guard('SUM(cs.conversions)', f'{COST} / {CONV}')} AS cost_per_conversion,
       {VALUE} AS conversion_value
FROM campaign_stats cs WHERE {_where(ADS_PERIOD)}
GROUP BY cs.date ORDER BY day""")


def conversions_by_campaign_version() -> Stmt:
    return Stmt(needs("campaign_stats", "campaign_history"), f"""SELECT ch.name AS campaign, {CONV} AS conversions
FROM campaign_stats cs JOIN campaign_history ch ON cs.id = ch.id
WHERE {_where(ADS_PERIOD)}
GROUP BY ch.name ORDER BY campaign""")


def campaign_performance() -> Stmt:
    return Stmt(needs(*STATS_LATEST), f"""SELECT ch.name AS campaign_name,
       {_perf('conversion_value', 'conversion_value_cost_ratio')}
FROM campaign_stats cs JOIN latest ch ON cs.id = ch.id
WHERE {_where(ADS_PERIOD)}
GROUP BY ch.name ORDER BY cost DESC NULLS FIRST""")


def product_performance() -> Stmt:
    return Stmt(needs("product_stats"), f"""SELECT cs.product_title,
       {_perf('conversions_value', 'conversion_value_cost')}
FROM product_stats cs
WHERE {_where(ADS_PERIOD)}
GROUP BY cs.product_title ORDER BY cost DESC NULLS FIRST""")


# --- organic -------------------------------------------------------------------------

def _organic_where(period, channel_col: str) -> str:
    return (
        f"date >= {_d(period.start)} AND date <= {_d(period.end)} "
        f"AND {channel_col} IN {_channels()}"
    )


def _purchases(period) -> str:
    return f"""SELECT CAST(SUM(event_count) AS BIGINT) AS total_seo_sales,
       CAST(SUM(total_revenue) AS DOUBLE) AS total_ga4_seo_revenue
FROM channel_event_report
WHERE {_organic_where(period, 'session_default_channel_group')} AND event_name = {_q(CONFIG.purchase_event)}"""


def _sessions(period) -> str:
    return f"""SELECT CAST(SUM(sessions) AS BIGINT) AS total_ga4_sessions,
       CAST(SUM(total_users) AS BIGINT) AS total_ga4_total_users
FROM channel_session_report WHERE {_organic_where(period, 'session_default_channel_grouping')}"""


def session_totals(period=ORGANIC_PERIOD) -> Stmt:
    return Stmt(needs("channel_session_report"), _sessions(period))


def purchase_totals(period=ORGANIC_PERIOD) -> Stmt:
    return Stmt(needs("channel_event_report"), _purchases(period))


def overview(null_policy: str = "zero") -> Stmt:
    """Twelve KPIs: each total is a scalar query, the ratios are taken in a second step."""
    p = OVERVIEW_PERIOD
    zero = (lambda e, z: f"COALESCE({e}, {z})") if null_policy == "zero" else (lambda e, z: e)
    ads, seen, bought = f"({known_campaign_totals(p).select})", f"({_sessions(p)})", f"({_purchases(p)})"
    pick = lambda column, query: f"(SELECT {column} FROM {query})"
    totals = {
        "google_ads_total_cost": zero(pick("total_cost", ads), "0.0"),
        "google_ads_total_conversions": zero(pick("total_conversions", ads), "0.0"),
        "google_ads_total_revenue": zero(pick("total_revenue", ads), "0.0"),
        "google_ads_total_roas": zero(pick("total_roas", ads), "0.0"),
        "ga4_total_sessions": f"CAST({zero(pick('total_ga4_sessions', seen), '0')} AS BIGINT)",
        "ga4_total_users": f"CAST({zero(pick('total_ga4_total_users', seen), '0')} AS BIGINT)",
        "total_seo_sales": f"CAST(COALESCE({pick('total_seo_sales', bought)}, 0) AS BIGINT)",
        "total_seo_revenue": f"COALESCE({pick('total_ga4_seo_revenue', bought)}, 0.0)",
    }
    cost, conv = "google_ads_total_cost", "google_ads_total_conversions"
    real = lambda column: f"CAST({column} AS DOUBLE)"
    ratios = {
        "cost_per_conversion": _guard(conv, f"{cost} / {conv}"),
        "conv_rate": _guard(cost, f"{conv} / {cost}"),
        "seo_conversion_rate": _guard("ga4_total_sessions", f"{real('total_seo_sales')} / {real('ga4_total_sessions')}"),
        "seo_cost_per_sale": _guard("total_seo_sales", f"{CONFIG.fixed_seo_cost!r} / {real('total_seo_sales')}"),
    }
    named = lambda columns: ",\n       ".join(f"{e} AS {n}" for n, e in columns.items())
    needed = needs(*STATS_LATEST, "channel_session_report", "channel_event_report")
    return Stmt([*needed, f"totals AS (SELECT {named(totals)})"], f"SELECT *,\n       {named(ratios)}\nFROM totals")


def organic_summary() -> Stmt:
    """The session and the event rows stacked, and one sum over both."""
    p = ORGANIC_PERIOD
    return Stmt(needs("channel_session_report", "channel_event_report"), f"""SELECT CAST(SUM(visits) AS BIGINT) AS ga4_sessions,
       CAST(COALESCE(SUM(fresh), 0) AS BIGINT) AS ga4_new_users,
       CAST(COALESCE(SUM(paid), 0) AS DOUBLE) AS ga4_total_revenue,
       CAST(COALESCE(SUM(n), 0) AS BIGINT) AS key_events
FROM (SELECT sessions AS visits, NULL::BIGINT AS fresh, NULL::DECIMAL(18,2) AS paid, NULL::BIGINT AS n FROM channel_session_report
      WHERE {_organic_where(p, 'session_default_channel_grouping')}
      UNION ALL
      SELECT NULL, new_users, total_revenue, event_count FROM channel_event_report
      WHERE {_organic_where(p, 'session_default_channel_group')})""")


def organic_daily_compare(shift: int) -> Stmt:
    """Both periods stacked on the reported day, then summed by side."""
    rows = lambda period, day, side: (
        f"SELECT CAST({day} AS DATE) AS day, {side} AS side, sessions, new_users, total_revenue, event_count "
        f"FROM channel_event_report WHERE {_organic_where(period, 'session_default_channel_group')}"
    )
    cols = ["day AS date"]
    for side, suffix in ((0, ""), (1, "_previous_period")):
        for source, name, kind in (
            ("sessions", "ga4_sessions", "BIGINT"), ("new_users", "ga4_new_users", "BIGINT"),
            ("total_revenue", "ga4_total_revenue", "DOUBLE"), ("event_count", "key_events", "BIGINT"),
        ):
            cols.append(f"CAST(COALESCE(SUM({source}) FILTER (WHERE side = {side}), 0) AS {kind}) AS {name}{suffix}")
    return Stmt(needs("channel_event_report"), "SELECT " + ",\n       ".join(cols) + f"""
FROM ({rows(ORGANIC_PERIOD, 'date', 0)}
      UNION ALL
      {rows(PREVIOUS_PERIOD, f'date + INTERVAL {shift} DAY', 1)})
GROUP BY day ORDER BY day""")


def organic_monthly() -> Stmt:
    p = TWELVE_MONTHS
    return Stmt(needs("channel_event_report_long"), f"""SELECT CAST(DATE_TRUNC('month', date) AS DATE) AS month,
       CAST(SUM(sessions) AS BIGINT) AS ga4_sessions, CAST(SUM(new_users) AS BIGINT) AS ga4_new_users,
       CAST(SUM(total_revenue) AS DOUBLE) AS ga4_total_revenue, CAST(SUM(event_count) AS BIGINT) AS key_events
FROM channel_event_report_long
WHERE {_organic_where(p, 'session_default_channel_group')}
GROUP BY 1 ORDER BY month""")


def latest_campaign() -> Stmt:
    return Stmt(needs("campaign_history", "latest"), "SELECT id, name FROM latest")


# --- U5, U1-U4 -----------------------------------------------------------------------

def segment_totals() -> Stmt:
    year = TRAILING_YEAR
    parts = [
        account_totals(ADS_PERIOD, "account"),
        named_totals(ADS_PERIOD, f"ch.name LIKE {_q(CONFIG.shopping_pattern)}", "shopping"),
        named_totals(ADS_PERIOD, f"ch.name NOT LIKE {_q(CONFIG.shopping_pattern)}", "search"),
        named_totals(year, _not_like(CONFIG.excluded_patterns), "trailing_year"),
    ]
    ctes = [c for p in parts for c in p.ctes]
    return Stmt(ctes, "\nUNION ALL\n".join(p.select for p in parts))


_DISPLAY = {
    "currency": "'£' || format('{{:,.2f}}', {v})",
    "decimal": "format('{{:,.2f}}', {v})",
    "count": "format('{{:,.0f}}', {v})",
    "multiple": "format('{{:.2f}}x', {v})",
    "percent": "format('{{:.2f}}%', {v} * 100.0)",
}


def _card(src: str, page: str, section_sql: str, pos: int, key: str, label: str, kind: str) -> str:
    v = f"CAST({key} AS DOUBLE)"
    disp = _DISPLAY[kind].format(v=v)
    return (
        f"SELECT {_q(page)} AS page, {section_sql} AS section, {pos} AS position, {_q(key)} AS key, "
        f"{_q(label)} AS label, {v} AS value, COALESCE({disp}, '') AS display FROM {src}"
    )


def metric_cards() -> Stmt:
    ctes = overview().as_cte("ov") + segment_totals().as_cte("seg") + organic_summary().as_cte("seo")
    selects = []
    for title, cards in OVERVIEW_CARDS:
        for i, (key, label, kind) in enumerate(cards, start=1):
            selects.append(_card("ov", "overview", _q(title), i, key, label, kind))
    section = "CASE segment " + " ".join(f"WHEN {_q(s)} THEN {_q(t)}" for s, t in ADS_SECTIONS.items()) + " END"
    for i, (key, label, kind) in enumerate(ADS_CARDS, start=1):
        selects.append(_card("seg", "ads", section, i, key, label, kind))
    for i, (key, label, kind) in enumerate(SEO_CARDS, start=1):
        selects.append(_card("seo", "seo", _q("Monthly Website Traffic"), i, key, label, kind))
    return Stmt(ctes, "\nUNION ALL\n".join(selects))


def chart_series() -> Stmt:
    ctes = (
        account_daily().as_cte("daily")
        + conversions_by_campaign_version().as_cte("conv")
        + organic_daily_compare(14).as_cte("seo_daily")
        + organic_monthly().as_cte("monthly")
    )
    parts = []

    def series(src, page, order, label, specs):
        for chart, name, measure in specs:
            parts.append(
                f"SELECT {_q(page)} AS page, {_q(chart)} AS chart, {_q(name)} AS series, "
                f"ROW_NUMBER() OVER (ORDER BY {order}) AS position, {label} AS x_label, "
                f"CAST({measure} AS DOUBLE) AS y FROM {src}"
            )

    series("daily", "ads", "day ASC NULLS LAST", "strftime(day, '%d %b')", ADS_DAILY_SERIES)
    series("conv", "ads", "campaign ASC NULLS LAST", "campaign", CAMPAIGN_SERIES)
    series("seo_daily", "seo", "date ASC NULLS LAST", "strftime(date, '%d %b')",
           SEO_DAILY_SERIES)
    series("monthly", "seo", "month ASC NULLS LAST", "strftime(month, '%b %y')",
           SEO_MONTHLY_SERIES)
    return Stmt(ctes, "\nUNION ALL\n".join(parts))


def product_search() -> Stmt:
    return Stmt(product_performance().as_cte("r"),
                f"SELECT * FROM r WHERE contains(upper(r.product_title), upper({_q(PRODUCT_QUERY)}))")


def sort_report() -> Stmt:
    return Stmt(campaign_performance().as_cte("r"), (
        "SELECT r.*, ROW_NUMBER() OVER (ORDER BY r.conversion_rate DESC NULLS LAST, "
        "r.campaign_name ASC NULLS LAST) AS position FROM r"
    ))


def _table(report: Stmt, measures: tuple[str, ...]) -> Stmt:
    kinds = ("currency", "decimal", "percent", "currency", "currency", "multiple")
    texts = ", ".join(
        f"COALESCE({_DISPLAY[k].format(v=f'r.{m}')}, '') AS {m}_text" for m, k in zip(measures, kinds, strict=True)
    )
    return Stmt(report.as_cte("r"), f"SELECT r.*, {texts} FROM r")


CAMPAIGN_MEASURES = ("cost", "conversions", "conversion_rate", "cost_per_conversion", "conversion_value", "conversion_value_cost_ratio")
PRODUCT_MEASURES = ("cost", "conversions", "conversion_rate", "cost_per_conversion", "conversions_value", "conversion_value_cost")


def sort_products() -> Stmt:
    return Stmt(product_search().as_cte("f"), (
        "SELECT f.*, ROW_NUMBER() OVER (ORDER BY f.conversions ASC NULLS LAST, f.product_title ASC NULLS LAST) AS position FROM f"
    ))


def sort_products_by_title() -> Stmt:
    return Stmt(product_performance().as_cte("r"), (
        "SELECT r.*, ROW_NUMBER() OVER (ORDER BY lower(r.product_title) ASC NULLS LAST, r.product_title ASC NULLS LAST) AS position FROM r"
    ))


def statements() -> dict[str, Stmt]:
    year = TRAILING_YEAR
    return {
        "known_campaign_totals": known_campaign_totals(),
        "session_totals": session_totals(),
        "purchase_totals": purchase_totals(),
        "marketing_overview": overview("zero"),
        "marketing_overview_nullable": overview("keep"),
        "account_totals": account_totals(),
        "shopping_totals": named_totals(ADS_PERIOD, f"ch.name LIKE {_q(CONFIG.shopping_pattern)}"),
        "search_totals": named_totals(ADS_PERIOD, f"ch.name NOT LIKE {_q(CONFIG.shopping_pattern)}"),
        "trailing_year_totals": named_totals(year, _not_like(CONFIG.excluded_patterns)),
        "account_daily": account_daily(),
        "conversions_by_campaign_version": conversions_by_campaign_version(),
        "campaign_performance": campaign_performance(),
        "product_performance": product_performance(),
        "organic_summary": organic_summary(),
        "organic_daily_compare": organic_daily_compare(14),
        "organic_daily_compare_aligned": organic_daily_compare(15),
        "organic_monthly": organic_monthly(),
        "latest_campaign": latest_campaign(),
        "segment_totals": segment_totals(),
        "metric_cards": metric_cards(),
        "chart_series": chart_series(),
        "product_search": product_search(),
        "sort_report": sort_report(),
        "campaign_table": _table(campaign_performance(), CAMPAIGN_MEASURES),
        "product_table": _table(product_performance(), PRODUCT_MEASURES),
        "sort_products": sort_products(),
        "sort_products_by_title": sort_products_by_title(),
        # Reports from maintained tables equal the reports themselves.
        "latest_campaign_maintained": latest_campaign(),
        "account_daily_restated": account_daily(),
        "trailing_year_by_months": named_totals(year, _not_like(CONFIG.excluded_patterns)),
        "segment_totals_by_months": segment_totals(),
        "organic_monthly_by_months": organic_monthly(),
    }


def oracle_sql() -> dict[str, str]:
    return {name: stmt.sql() for name, stmt in statements().items()}
