"""kpiloom: paid-search and organic-traffic reporting as lazy Spark DataFrame jobs.

Every report takes logical input DataFrames (see ``kpiloom.sources.tables``) and
returns a lazy ``DataFrame`` built from built-in Spark SQL functions, so scans,
joins and aggregates run distributed and only the aggregated result reaches the
caller.
"""

from kpiloom.config import ReportConfig
from kpiloom.period import (
    Period,
    last_12_months,
    previous_period,
    resolve_period,
    trailing_year,
)

__all__ = [
    "Period",
    "ReportConfig",
    "last_12_months",
    "previous_period",
    "resolve_period",
    "trailing_year",
]
