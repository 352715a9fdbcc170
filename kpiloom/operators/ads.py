"""Paid-search reports over ``campaign_stats`` / ``campaign_history`` / ``product_stats``.

Plan shape shared by the reports that need campaign names: the stats are filtered
(account + inclusive date range, pushed into the scan), summed per campaign ``id``
with map-side partial aggregation, and only then joined to the dimension. All
measures are sums, so summing before the join gives the reference's row-level
results while the join input shrinks from one row per stats row to one per id.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from kpiloom.functions.measures import (
    MEASURE_SUMS,
    PRODUCT_SUMS,
    SUM_CONVERSIONS,
    SUM_MICROS,
    SUM_VALUE,
    as_double,
    kpi_columns,
    money,
    performance_columns,
    ratio,
    resum,
    stat_sums,
)
from kpiloom.operators.dims import campaign_ids, history_of, latest_campaign, version_names
from kpiloom.period import Period, trailing_year
from kpiloom.sources.tables import KeyedProducts


def in_period(period: Period, col: str = "date") -> Column:
    """Inclusive range with date literals (pushed down as a scan filter)."""
    return F.col(col).between(F.lit(period.start), F.lit(period.end))


def is_account(stats: DataFrame, customer_id: str) -> Column:
    """The account filter in the column's own type, so that it reaches the scan. Text that
    is no number equals no numeric id."""
    kind = stats.schema["customer_id"].dataType
    if not isinstance(kind, IntegralType):
        return F.col("customer_id") == F.lit(customer_id)
    try:
        return F.col("customer_id") == F.lit(int(customer_id)).cast(kind if abs(int(customer_id)) < 2**31 else "bigint")
    except ValueError:
        return F.lit(False)


def account_rows(stats: DataFrame, period: Period, customer_id: str) -> DataFrame:
    return stats.where(is_account(stats, customer_id) & in_period(period))


def stats_by_id(stats: DataFrame, period: Period, customer_id: str, measures=MEASURE_SUMS) -> DataFrame:
    """Per campaign id sums for one account and period (hash-partitioned by id). Rows without an
    id belong to no campaign: every use joins on it."""
    rows = account_rows(stats, period, customer_id).where(F.col("id").isNotNull())
    return rows.groupBy("id").agg(*stat_sums(measures=measures))


def name_like(pattern: str) -> Column:
    return F.col("name").like(pattern)


def name_not_like(*patterns: str) -> Column:
    """All patterns fail to match. A NULL name satisfies neither LIKE nor NOT LIKE."""
    cond = None
    for p in patterns:
        c = ~F.col("name").like(p)
        cond = c if cond is None else cond & c
    return cond if cond is not None else F.lit(True)


# --- R1a --------------------------------------------------------------------------

def known_campaign_totals(
    stats: DataFrame, history: DataFrame, period: Period, customer_id: str
) -> DataFrame:
    """Cost, conversions, revenue and ROAS of stats rows whose id has a history.

    The reference joins the ``rn = 1`` version, which matches at most one row per id:
    an existence test. It is an inner join of the per-id sums with the *distinct* ids
    (same result as a semi join). A ``left_semi`` join would be pushed below the per-id
    aggregate by Catalyst, so every stats row would be shuffled before summing; the
    inner join keeps the map-side partial sums in front of the shuffle.
    """
    per_id = stats_by_id(stats, period, customer_id)
    known = per_id.join(campaign_ids(history), "id")
    mic, conv, val = F.col(SUM_MICROS), F.col(SUM_CONVERSIONS), F.col(SUM_VALUE)
    return known.agg(*resum((SUM_MICROS, SUM_CONVERSIONS, SUM_VALUE))).select(
        money(mic).alias("total_cost"),
        as_double(conv).alias("total_conversions"),
        as_double(val).alias("total_revenue"),
        ratio(val, money(mic), guard=mic).alias("total_roas"),
    )


# --- R2 - R5 ------------------------------------------------------------------------

def account_totals(stats: DataFrame, period: Period, customer_id: str) -> DataFrame:
    """Ten KPIs for the account and period; no dimension join. One row."""
    return account_rows(stats, period, customer_id).agg(*stat_sums()).select(
        *kpi_columns(coalesce_zero=True)
    )


def _latest(history: DataFrame, latest: DataFrame | None, ids: DataFrame) -> DataFrame:
    """The latest-version dimension: precomputed by a page plan, or derived here from the
    history of ``ids``, the campaigns of the period."""
    return latest if latest is not None else latest_campaign(history, ids)


def _named_totals(
    stats: DataFrame, history: DataFrame, period: Period, customer_id: str, name_filter: Column,
    latest: DataFrame | None = None,
) -> DataFrame:
    per_id = stats_by_id(stats, period, customer_id)
    named = _latest(history, latest, per_id).where(name_filter).select("id")
    return (
        per_id.join(named, "id")
        .agg(*resum())
        .select(*kpi_columns(coalesce_zero=True))
    )


def shopping_totals(
    stats: DataFrame, history: DataFrame, period: Period, customer_id: str,
    pattern: str = "%Shopping%", latest: DataFrame | None = None,
) -> DataFrame:
    """KPIs of campaigns whose latest name matches ``pattern`` (case-sensitive LIKE)."""
    return _named_totals(stats, history, period, customer_id, name_like(pattern), latest)


def search_totals(
    stats: DataFrame, history: DataFrame, period: Period, customer_id: str,
    pattern: str = "%Shopping%", latest: DataFrame | None = None,
) -> DataFrame:
    """KPIs of campaigns whose latest name does not match ``pattern`` (NULL names excluded)."""
    return _named_totals(stats, history, period, customer_id, name_not_like(pattern), latest)


def trailing_year_totals(
    stats: DataFrame, history: DataFrame, today: date, customer_id: str,
    excluded: tuple[str, ...] = ("%Germany%", "%Netherlands%"), latest: DataFrame | None = None,
) -> DataFrame:
    """KPIs over the 366 days ending yesterday, campaigns matching none of ``excluded``."""
    return _named_totals(
        stats, history, trailing_year(today), customer_id, name_not_like(*excluded), latest
    )


# --- R6 ---------------------------------------------------------------------------

def account_daily(
    stats: DataFrame, period: Period, customer_id: str, ordered: bool = True
) -> DataFrame:
    """Per day of the period with data (no gap filling), ordered by day.

    ``ordered=False`` skips the final global sort for callers that re-sort anyway."""
    agg = (
        account_rows(stats, period, customer_id)
        .groupBy(F.col("date").alias("day"))
        .agg(*stat_sums())
    )
    mic, conv, val = F.col(SUM_MICROS), F.col(SUM_CONVERSIONS), F.col(SUM_VALUE)
    out = agg.select(
        "day",
        F.col("sum_impressions").alias("impressions"),
        F.col("sum_clicks").alias("clicks"),
        as_double(conv).alias("conversions"),
        ratio(money(mic), conv).alias("cost_per_conversion"),
        as_double(val).alias("conversion_value"),
    )
    return out.orderBy(F.col("day").asc_nulls_last()) if ordered else out


# --- R7 ---------------------------------------------------------------------------

def conversions_by_campaign_version(
    stats: DataFrame, history: DataFrame, period: Period, customer_id: str,
    dedup: bool = False, latest: DataFrame | None = None, ordered: bool = True,
    versions: DataFrame | None = None,
) -> DataFrame:
    """Conversions per campaign name, ordered by name (``ordered=False``: unsorted).
    ``versions``: a precomputed ``version_names`` (a page plan's).

    Faithful form (``dedup=False``): the reference joins every version, so a stats
    row counts once per version of its campaign, under every name it ever had. The
    plan sums conversions per id and multiplies by the number of versions per
    (id, name) instead of joining row by row: the same sums, and neither join side
    grows with the versions of a hot id. ``dedup=True`` uses the latest name only.
    """
    per_id = stats_by_id(stats, period, customer_id, [m for m in MEASURE_SUMS if m[1] == SUM_CONVERSIONS])
    if dedup:
        joined = per_id.join(_latest(history, latest, per_id), "id")
        conv = F.col(SUM_CONVERSIONS)
    else:
        joined = per_id.join(versions if versions is not None else version_names(history_of(history, per_id)), "id")
        conv = F.col(SUM_CONVERSIONS) * F.col("n_versions")
    out = joined.groupBy(F.col("name").alias("campaign")).agg(
        as_double(F.sum(conv)).alias("conversions")
    )
    return out.orderBy(F.col("campaign").asc_nulls_last()) if ordered else out


# --- R8 ---------------------------------------------------------------------------

def campaign_performance(
    stats: DataFrame, history: DataFrame, period: Period, customer_id: str,
    latest: DataFrame | None = None, ordered: bool = True,
) -> DataFrame:
    """Per latest campaign name (ids sharing a name merge), by cost descending
    (``ordered=False``: unsorted, for callers that sort differently)."""
    per_id = stats_by_id(stats, period, customer_id, PRODUCT_SUMS)
    by_name = (
        per_id.join(_latest(history, latest, per_id), "id")
        .groupBy(F.col("name").alias("campaign_name"))
        .agg(*resum([out for _, out in PRODUCT_SUMS]))
    )
    out = by_name.select(
        "campaign_name",
        *performance_columns("conversion_value", "conversion_value_cost_ratio"),
    )
    return by_cost(out) if ordered else out


# --- R9 ---------------------------------------------------------------------------

def product_performance(
    products: DataFrame | KeyedProducts, period: Period, customer_id: str, ordered: bool = True
) -> DataFrame:
    """Per product title (NULL titles form one group), by cost descending
    (``ordered=False``: unsorted).

    Products in two tables are summed per product id before the join, which then has one row per
    id: the value of n rows is n times that of one. Ids that share a title merge after it.
    """
    if isinstance(products, KeyedProducts):
        own = [m for m in PRODUCT_SUMS if m[1] != SUM_VALUE]
        rows = account_rows(products.facts, period, customer_id).where(F.col("product_id").isNotNull())
        per_id = rows.groupBy("product_id").agg(*stat_sums(measures=own), F.count(F.lit(1)).alias("_rows"))
        value = F.col("conversions_value") * F.col("_rows").cast("decimal(18,0)")
        summed = per_id.join(products.products, "product_id").withColumn(SUM_VALUE, value).groupBy("product_title")
        by_title = summed.agg(*resum([out for _, out in PRODUCT_SUMS]))
    else:
        by_title = account_rows(products, period, customer_id).groupBy("product_title").agg(*stat_sums(measures=PRODUCT_SUMS))
    out = by_title.select(
        "product_title",
        *performance_columns("conversions_value", "conversion_value_cost"),
    )
    return by_cost(out) if ordered else out


def by_cost(report: DataFrame) -> DataFrame:
    """A campaign or product report by cost descending, then by its first column."""
    return report.orderBy(F.col("cost").desc_nulls_first(), F.col(report.columns[0]).asc_nulls_last())
