"""The tables of one page read from a database over JDBC.

The page's own periods become the queries: the periods that a table is read for are merged, cut
into ranges of at most ``days`` days, and every range is one query with the account as a literal.
So the database is asked only for rows that some report of the page uses, no row is read twice
where periods overlap, and the queries run in parallel, each in a task of its own. The campaign
history has no period; its queries are ranges of ids that the caller names. Spark adds the columns
and filters of the reports to each query.

Connection options (driver, user, password) come from the caller and are passed on as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import SparkSession

from kpiloom.config import ReportConfig
from kpiloom.period import Period, last_12_months, previous_period, trailing_year
from kpiloom.sources.tables import Tables, read_jdbc

#: Tables whose rows belong to an account.
ACCOUNT_TABLES = ("campaign_stats", "product_stats")


@dataclass(frozen=True)
class Database:
    """``tables`` maps logical names to the database's. ``history_ids`` is (lowest, highest, number
    of queries) for the campaign history; ids outside are read by the first and the last."""

    url: str
    tables: dict[str, str]
    properties: dict[str, str] = field(default_factory=dict, repr=False)
    days: int = 31
    history_ids: tuple[int, int, int] | None = None


def page_periods(page: str, period: Period, today: date) -> dict[str, list[Period]]:
    """The periods for which ``page`` reads each dated table."""
    if page == "overview":
        return {"campaign_stats": [period], "channel_session_report": [period], "channel_event_report": [period]}
    if page == "ads":
        return {"campaign_stats": [period, trailing_year(today)], "product_stats": [period]}
    if page == "seo":
        events = [period, previous_period(period).previous, last_12_months(today)]
        return {"channel_session_report": [period], "channel_event_report": events}
    raise ValueError(f"unknown page {page!r}")


def date_ranges(periods: list[Period], days: int) -> list[Period]:
    """Disjoint ranges of at most ``days`` days that cover the periods, and nothing else."""
    if days < 1:
        raise ValueError("a query covers at least one day")
    merged: list[Period] = []
    for p in sorted((p for p in periods if p.start <= p.end), key=lambda p: p.start):
        if merged and p.start <= merged[-1].end + timedelta(days=1):
            merged[-1] = Period(merged[-1].start, max(merged[-1].end, p.end))
        else:
            merged.append(p)
    out = []
    for p in merged:
        start = p.start
        while start <= p.end:
            end = min(p.end, start + timedelta(days=days - 1))
            out.append(Period(start, end))
            start = end + timedelta(days=1)
    return out


def text_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def date_predicates(periods: list[Period], days: int, customer_id: str | None = None) -> list[str]:
    """One predicate per range. A half-open range holds the whole last day of a timestamp column
    too. Without any day there is one predicate that no row meets."""
    account = "" if customer_id is None else f" AND customer_id = {text_literal(customer_id)}"
    return [
        f"date >= DATE '{r.start}' AND date < DATE '{r.end + timedelta(days=1)}'{account}" for r in date_ranges(periods, days)
    ] or ["1 = 0"]


def id_predicates(bounds: tuple[int, int, int]) -> list[str]:
    """Ranges of campaign ids; the first and the last are open, so no id is left out. Rows without
    an id belong to no campaign."""
    low, high, queries = bounds
    if queries < 1 or low > high:
        raise ValueError("history ids: lowest <= highest, and at least one query")
    cuts = sorted({low + (high - low + 1) * k // queries for k in range(1, queries)} - {low})
    if not cuts:
        return ["id IS NOT NULL"]
    inner = [f"id >= {a} AND id < {b}" for a, b in zip(cuts, cuts[1:], strict=False)]
    return [f"id < {cuts[0]}", *inner, f"id >= {cuts[-1]}"]


def page_predicates(db: Database, page: str, period: Period, config: ReportConfig, today: date) -> dict[str, list[str]]:
    """The predicates of every table that ``page`` reads, one query each."""
    out = {
        table: date_predicates(periods, db.days, config.customer_id if table in ACCOUNT_TABLES else None)
        for table, periods in page_periods(page, period, today).items()
    }
    if page in ("overview", "ads"):
        if db.history_ids is None:
            raise ValueError(
                "campaign_history has no period to read it by: give the bounds of its ids (lowest, highest, number of queries)"
            )
        out["campaign_history"] = id_predicates(db.history_ids)
    return out


def read_page_tables(spark: SparkSession, db: Database, page: str, period: Period, config: ReportConfig, today: date) -> Tables:
    """The tables that ``page`` reads, as lazy scans of one task per query."""
    predicates = page_predicates(db, page, period, config, today)
    missing = sorted(set(predicates) - set(db.tables))
    if missing:
        raise ValueError(f"page {page!r} needs the tables {', '.join(missing)}")
    return Tables(**{
        name: read_jdbc(spark, db.url, db.tables[name], name, properties=dict(db.properties), predicates=own)
        for name, own in predicates.items()
    })
