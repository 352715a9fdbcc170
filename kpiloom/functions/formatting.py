"""Display strings and labels for KPI cards and chart axes (built-in functions only).

Number formats follow Python's ``format`` mini-language as used by the report
templates: ``{:,.2f}`` is ``format_number(x, 2)`` (both round half-even on the
exact binary value), ``{:.2f}`` is the same without thousands separators.
A NULL value displays as an empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The currency symbol and the format kinds of the report templates.
CURRENCY = "£"
FORMATS = {
    "currency": "£{:,.2f}",
    "decimal": "{:,.2f}",
    "count": "{:,.0f}",
    "multiple": "{:.2f}x",
    "percent": "{:.2f}%",
}


def sql_str(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def display_sql(value: str, kind: str) -> str:
    """SQL of the text of a numeric column in one of ``FORMATS`` (percent multiplies by 100). SQL
    text because a table has dozens of cells: one parsed expression each."""
    v = f"CAST({value} AS DOUBLE)"
    forms = {
        "currency": f"concat({sql_str(CURRENCY)}, format_number({v}, 2))",
        "decimal": f"format_number({v}, 2)",
        "count": f"format_number({v}, 0)",
        "multiple": f"concat(regexp_replace(format_number({v}, 2), ',', ''), 'x')",
        "percent": f"concat(regexp_replace(format_number({v} * 100.0D, 2), ',', ''), '%')",
    }
    if kind not in forms:
        raise ValueError(f"unknown format kind {kind!r}")
    return f"coalesce({forms[kind]}, '')"


def title_label_sql(key: str) -> str:
    """``replace('_', ' ') | title``: words capitalised, the rest lower-cased."""
    return f"initcap(replace({sql_str(key)}, '_', ' '))"


def day_label_sql(col: str) -> str:
    """Daily axis label, e.g. ``05 Jan``."""
    return f"date_format({col}, 'dd MMM')"


def month_label_sql(col: str) -> str:
    """Monthly axis label, e.g. ``Jan 24``."""
    return f"date_format({col}, 'MMM yy')"


def display_number(text: Column) -> Column:
    """Numeric value of a display string, like the report table's sort key: whitespace
    and every character except digits, ``.`` and ``-`` are dropped, the longest leading
    number is read (as ``parseFloat`` does) and anything unreadable becomes 0."""
    kept = F.regexp_replace(F.regexp_replace(text, r"\s+", ""), r"[^0-9.\-]", "")
    lead = F.regexp_extract(kept, r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)", 0)
    return F.coalesce(lead.try_cast("double"), F.lit(0.0))
