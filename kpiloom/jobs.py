"""Batch entry point: one dashboard page for two dates, written as report tables.

The reference's users open a page with ``start_date`` / ``end_date`` (both valid, or
else the previous calendar month). Here the same two dates drive a Spark job that
writes every report of the page as one version under ``--out`` (``sinks.read_page``):

    spark-submit --py-files kpiloom.zip kpiloom/jobs.py ads --start 2024-03-01 --end 2024-03-31 \\
        --campaign-stats s3://.../campaign_stats --campaign-history s3://.../history \\
        --product-stats s3://.../products --customer-id 123 --out s3://.../reports/2024-03

With ``--jdbc-url`` the tables are read from a database: the same options then hold its table
names, ``--history-ids LOW:HIGH:QUERIES`` the bounds of the campaign ids, and
``--jdbc-properties FILE`` the driver's options (``key=value`` lines: driver, user, password).
"""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import SparkSession

from kpiloom.config import ReportConfig
from kpiloom.period import Period, resolve_period
from kpiloom.plans import dashboards
from kpiloom.sources.jdbc import Database, read_page_tables
from kpiloom.sources.sinks import write_page
from kpiloom.sources.tables import Tables, read_tables

PAGES = ("overview", "ads", "seo")
TABLE_ARGS = (
    "campaign_stats", "campaign_history", "product_stats",
    "channel_session_report", "channel_event_report",
)
PAGE_TABLES = {
    "overview": ("campaign_stats", "campaign_history", "channel_session_report", "channel_event_report"),
    "ads": ("campaign_stats", "campaign_history", "product_stats"),
    "seo": ("channel_session_report", "channel_event_report"),
}


def build_page(page: str, tables: Tables, period: Period, config: ReportConfig, today: date) -> dashboards.Page:
    if page == "overview":
        return dashboards.overview_page(tables, period, config)
    if page == "ads":
        return dashboards.ads_page(tables, period, config, today)
    if page == "seo":
        return dashboards.seo_page(tables, period, config, today)
    raise ValueError(f"unknown page {page!r}; expected one of {PAGES}")


def page_reports(
    spark: SparkSession,
    page: str,
    source: dict[str, str] | Database,
    config: ReportConfig,
    start: str | None,
    end: str | None,
    today: date,
) -> dashboards.Page:
    """The reports of ``page`` for the resolved period (lazy; the page's shared tables are
    materialised on use, and ``close`` removes them). ``source``: Parquet paths by logical table
    name, or a database."""
    held = source.tables if isinstance(source, Database) else source
    missing = [t for t in PAGE_TABLES.get(page, ()) if t not in held]
    if missing:
        raise ValueError(f"page {page!r} needs the tables {', '.join(missing)}")
    period = resolve_period(start, end, today)
    if isinstance(source, Database):
        tables = read_page_tables(spark, source, page, period, config, today)
    else:
        tables = read_tables(spark, source)
    return build_page(page, tables, period, config, today)


def id_bounds(text: str) -> tuple[int, int, int]:
    """``LOW:HIGH:QUERIES``"""
    try:
        low, high, queries = (int(x) for x in text.split(":"))
    except ValueError:
        raise argparse.ArgumentTypeError(f"{text!r} is not LOW:HIGH:QUERIES") from None
    return low, high, queries


def read_properties(path: str | None) -> dict[str, str]:
    """``key=value`` lines; blank lines and lines that start with # are skipped."""
    if not path:
        return {}
    with open(path) as f:
        lines = [line.strip() for line in f]
    pairs = [line.partition("=") for line in lines if line and not line.startswith("#")]
    bad = [key for key, eq, _ in pairs if not eq or not key.strip()]
    if bad:
        raise ValueError(f"{path}: a line is not key=value")
    return {key.strip(): value.strip() for key, _, value in pairs}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="kpiloom", description=__doc__.splitlines()[0])
    p.add_argument("page", choices=PAGES)
    p.add_argument("--start")
    p.add_argument("--end")
    p.add_argument("--today", help="YYYY-MM-DD; defaults to the current date")
    p.add_argument("--customer-id", required=True)
    p.add_argument("--channels", default="Organic Search,Organic Shopping")
    p.add_argument("--shopping-pattern", default="%Shopping%")
    p.add_argument("--excluded-patterns", default="%Germany%,%Netherlands%")
    p.add_argument("--fixed-seo-cost", type=float, default=2050.0)
    p.add_argument("--out", required=True)
    for t in TABLE_ARGS:
        p.add_argument("--" + t.replace("_", "-"), help="Parquet path, or with --jdbc-url the database's table")
    p.add_argument("--jdbc-url")
    p.add_argument("--jdbc-properties", metavar="FILE", help="key=value lines for the driver")
    p.add_argument("--jdbc-days", type=int, default=31, help="days that one query covers at most")
    p.add_argument("--history-ids", type=id_bounds, metavar="LOW:HIGH:QUERIES", help="bounds of the campaign ids (JDBC)")
    a = p.parse_args(argv)

    config = ReportConfig(
        customer_id=a.customer_id,
        channels=tuple(c for c in a.channels.split(",") if c),
        shopping_pattern=a.shopping_pattern,
        excluded_patterns=tuple(x for x in a.excluded_patterns.split(",") if x),
        fixed_seo_cost=a.fixed_seo_cost,
    )
    paths = {t: getattr(a, t) for t in TABLE_ARGS if getattr(a, t)}
    today = date.fromisoformat(a.today) if a.today else date.today()
    if a.jdbc_url:
        source = Database(a.jdbc_url, paths, read_properties(a.jdbc_properties), a.jdbc_days, a.history_ids)
    else:
        source = paths
    spark = SparkSession.builder.appName(f"kpiloom-{a.page}").getOrCreate()
    with page_reports(spark, a.page, source, config, a.start, a.end, today) as reports:
        write_page(spark, reports, a.out)


if __name__ == "__main__":
    main()
