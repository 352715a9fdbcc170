"""The ads page's KPI segments from one scan of the stats (conditional aggregation).

The reference runs one statement per segment (four scans of the fact table and the
latest-version dedup three times). Here the stats are filtered once to the union
of the ads period and the trailing year, summed per campaign id with one set of
sums per period, left-joined once to the latest campaign names, and every segment
is a conditional sum over that per-id relation. Numbers equal the separate reports.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.config import ReportConfig
from kpiloom.functions.measures import STAT_SUMS, kpi_columns, stat_sums
from kpiloom.functions.formatting import sql_str
from kpiloom.operators.ads import in_period, is_account
from kpiloom.operators.dims import latest_campaign
from kpiloom.period import Period, trailing_year

SEGMENTS = ("account", "shopping", "search", "trailing_year")


def _suffixed(cols: list[Column], suffix: str) -> list[Column]:
    return [c.alias(n + suffix) for c, n in zip(cols, STAT_SUMS)]


def segment_sums(
    stats: DataFrame,
    history: DataFrame,
    period: Period,
    config: ReportConfig,
    today: date | None = None,
    latest: DataFrame | None = None,
    known_period: Period | None = None,
) -> tuple[DataFrame, list[str]]:
    """(one row of sums named ``<segment>__<sum>``, the segments), from one scan of the stats
    and one pass over the history. With ``known_period`` the last segment is ``known``: ids
    that have a history, over that period (R1a)."""
    conds = {"_p": in_period(period)}
    if today is not None:
        conds["_y"] = in_period(trailing_year(today))
    if known_period is not None:
        conds["_k"] = in_period(known_period)
    any_period = None
    for c in conds.values():
        any_period = c if any_period is None else any_period | c
    rows = stats.where(is_account(stats, config.customer_id) & any_period)

    per_id = rows.groupBy("id").agg(
        *[c for suffix, when in conds.items() for c in _suffixed(stat_sums(when=when), suffix)]
    )
    dim = latest if latest is not None else latest_campaign(history)
    named = per_id.join(dim.withColumn("_known", F.lit(True)), "id", "left")

    shopping = f"name LIKE {sql_str(config.shopping_pattern)}"
    search = f"NOT (name LIKE {sql_str(config.shopping_pattern)})"
    kept = " AND ".join(f"NOT (name LIKE {sql_str(p)})" for p in config.excluded_patterns) or "_known"

    def seg_sums(suffix: str, cond: str | None, seg: str) -> list[Column]:
        # Conditional sums as SQL text: one parsed expression per output column.
        # A NULL name fails both LIKE and NOT LIKE, as in the separate reports.
        return [
            F.expr(f"sum({n}{suffix}) AS {seg}__{n}") if cond is None
            else F.expr(f"sum(CASE WHEN {cond} THEN {n}{suffix} END) AS {seg}__{n}")
            for n in STAT_SUMS
        ]

    plan = [("account", "_p", None), ("shopping", "_p", shopping), ("search", "_p", search)]
    if today is not None:
        plan.append(("trailing_year", "_y", kept))
    if known_period is not None:
        plan.append(("known", "_k", "_known"))
    return named.agg(*[c for seg, sfx, cond in plan for c in seg_sums(sfx, cond, seg)]), [p[0] for p in plan]


def segment_totals(
    stats: DataFrame,
    history: DataFrame,
    period: Period,
    config: ReportConfig,
    today: date | None = None,
    latest: DataFrame | None = None,
) -> DataFrame:
    """``segment`` + the ten KPIs of ``account_totals``; one row per segment.

    Segments: ``account`` (R2), ``shopping`` (R3), ``search`` (R4) over ``period``,
    and ``trailing_year`` (R5) over ``trailing_year(today)`` when ``today`` is given.
    """
    wide, segments = segment_sums(stats, history, period, config, today, latest)
    rows_of_segments = F.array(*[
        F.struct(F.lit(seg).alias("segment"), *[F.col(f"{seg}__{n}").alias(n) for n in STAT_SUMS])
        for seg in segments
    ])
    return wide.select(F.inline(rows_of_segments)).select(
        "segment", *kpi_columns(coalesce_zero=True)
    )
