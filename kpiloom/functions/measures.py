"""Measures written once: exact sums, currency conversion and zero-safe ratios.

Rules (SURVEY §1.4):
* sums are exact: counts as LONG, micros as DECIMAL(38,0) (a LONG sum overflows
  near 9.2e18 micros on very large accounts), decimal measures as DECIMAL;
* every ratio divides two sums, never averages row ratios;
* ``ratio(n, d)`` is ``n / d`` when ``d > 0``, else 0 (a NULL or negative
  denominator also gives 0; a NULL numerator over a positive denominator stays NULL);
* outputs are DOUBLE, converted once from the exact sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_UNIT = 1_000_000.0

# Names of the pre-aggregated sum columns used between operators.
SUM_IMPRESSIONS = "sum_impressions"
SUM_CLICKS = "sum_clicks"
SUM_MICROS = "sum_cost_micros"
SUM_CONVERSIONS = "sum_conversions"
SUM_VALUE = "sum_conversions_value"

STAT_SUMS = (SUM_IMPRESSIONS, SUM_CLICKS, SUM_MICROS, SUM_CONVERSIONS, SUM_VALUE)


def exact_micros(col: Column) -> Column:
    return col.cast("decimal(38,0)")


# Source column -> sum column, for the campaign measures.
MEASURE_SUMS = (
    ("impressions", SUM_IMPRESSIONS),
    ("clicks", SUM_CLICKS),
    ("cost_micros", SUM_MICROS),
    ("conversions", SUM_CONVERSIONS),
    ("conversions_value", SUM_VALUE),
)
PRODUCT_SUMS = tuple(m for m in MEASURE_SUMS if m[0] != "impressions")


def stat_sums(
    when: Column | None = None,
    measures=MEASURE_SUMS,
) -> list[Column]:
    """Partial-aggregation friendly sums of the campaign measures.

    ``when`` restricts a sum to matching rows (conditional aggregation over a shared
    scan).
    """

    def s(col: Column, out: str) -> Column:
        return F.sum(col if when is None else F.when(when, col)).alias(out)

    return [
        s(exact_micros(F.col(src)) if src == "cost_micros" else F.col(src), out)
        for src, out in measures
    ]


def resum(names=STAT_SUMS, when: Column | None = None) -> list[Column]:
    """Re-aggregate already summed columns (sums are additive)."""
    out = []
    for n in names:
        c = F.col(n) if when is None else F.when(when, F.col(n))
        out.append(F.sum(c).alias(n))
    return out


def as_double(col: Column) -> Column:
    return col.cast("double")


def money(micros_sum: Column) -> Column:
    """Exact micros sum -> currency units as DOUBLE (one conversion, one division)."""
    return micros_sum.cast("double") / F.lit(MICROS_PER_UNIT)


def ratio(numerator: Column, denominator: Column, guard: Column | None = None) -> Column:
    """``numerator / denominator`` when the guard (default: denominator) is > 0, else 0.0."""
    g = denominator if guard is None else guard
    return F.when(g > 0, as_double(numerator) / as_double(denominator)).otherwise(F.lit(0.0))


# SQL text forms of the same rules. A report projects ten to twenty such columns; one
# parsed expression per column keeps plan construction cheap on the driver.

def money_sql(micros_sum: str) -> str:
    return f"(CAST({micros_sum} AS DOUBLE) / {MICROS_PER_UNIT!r}D)"


def ratio_sql(numerator: str, denominator: str, guard: str | None = None) -> str:
    g = denominator if guard is None else guard
    return (
        f"CASE WHEN {g} > 0 THEN CAST({numerator} AS DOUBLE) / CAST({denominator} AS DOUBLE) "
        f"ELSE 0.0D END"
    )


def kpi_columns(coalesce_zero: bool, prefix: str = "") -> list[Column]:
    """The ten account KPIs from the sum columns (impressions ... conv_rate); ``prefix`` is
    that of the sum columns and of the KPIs.

    ``coalesce_zero`` turns every NULL (sums over no rows, a ratio with a NULL
    numerator) into 0 like the reference's ``None -> 0`` pass over one-row results.
    """
    imp, clk, mic, conv, val = (prefix + n for n in STAT_SUMS)
    cost = money_sql(mic)
    cols = [
        (f"CAST({imp} AS BIGINT)", "impressions"),
        (f"CAST({clk} AS BIGINT)", "clicks"),
        (ratio_sql(cost, clk), "cpc"),
        (cost, "cost"),
        (ratio_sql(cost, conv), "conversion_cost"),
        (f"CAST({conv} AS DOUBLE)", "conversions"),
        (f"CAST({val} AS DOUBLE)", "conversion_value"),
        (ratio_sql(val, cost, guard=mic), "roas"),
        (ratio_sql(clk, imp), "ctr"),
        (ratio_sql(conv, clk), "conv_rate"),
    ]
    if coalesce_zero:
        return [F.expr(f"coalesce({e}, CAST(0 AS {c_type(n)})) AS {prefix}{n}") for e, n in cols]
    return [F.expr(f"{e} AS {prefix}{n}") for e, n in cols]


def c_type(kpi: str) -> str:
    return "bigint" if kpi in ("impressions", "clicks") else "double"


def performance_columns(value_name: str, value_cost_name: str) -> list[Column]:
    """Per-group performance measures (campaign or product tables)."""
    clk, mic, conv, val = SUM_CLICKS, SUM_MICROS, SUM_CONVERSIONS, SUM_VALUE
    cost = money_sql(mic)
    cols = [
        (cost, "cost"),
        (f"CAST({conv} AS DOUBLE)", "conversions"),
        (ratio_sql(conv, clk), "conversion_rate"),
        (ratio_sql(cost, conv), "cost_per_conversion"),
        (f"CAST({val} AS DOUBLE)", value_name),
        (ratio_sql(val, cost, guard=mic), value_cost_name),
    ]
    return [F.expr(f"{e} AS {n}") for e, n in cols]


def combine_single_rows(*rows: DataFrame) -> DataFrame:
    """One row holding the columns of several one-row aggregates, without a join.

    Each input is padded with typed NULLs for the others' columns, the inputs are
    unioned, and one global ``max`` per column picks the single non-NULL value (or
    keeps NULL when that aggregate was NULL). Column names must be distinct.
    """
    fields = [f for df in rows for f in df.schema.fields]
    names = [f.name for f in fields]
    if len(set(names)) != len(names):
        raise ValueError(f"duplicate columns: {names}")
    padded = []
    for df in rows:
        own = set(df.columns)
        padded.append(df.selectExpr(*[
            f"`{f.name}`" if f.name in own
            else f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`"
            for f in fields
        ]))
    union = padded[0]
    for df in padded[1:]:
        union = union.unionByName(df)
    return union.agg(*[F.expr(f"max(`{n}`) AS `{n}`") for n in names])
