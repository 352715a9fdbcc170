"""Bindings of the logical tables to the driver's synthetic tables (FIXTURES.md part B).

Each binding is a lazy projection (plus one equi-join where the product measures live
in two tables), so filters on the logical columns are pushed back into the physical
scans: ``customer_id = 'O'`` becomes ``l_linestatus = 'O'`` and a ``date`` range
becomes a ``l_shipdate`` range in the Parquet reader.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.sources.tables import MONEY, KeyedProducts

# Channel group assigned by ``key % 4`` in the test bindings.
CHANNEL_BY_REMAINDER = ("Organic Search", "Organic Shopping", "Direct", "Paid Search")


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _channel(key: Column) -> Column:
    r = key % 4
    expr = F.when(r == 0, CHANNEL_BY_REMAINDER[0])
    for i, label in enumerate(CHANNEL_BY_REMAINDER[1:], start=1):
        expr = expr.when(r == i, label)
    return expr


def _as_date(ts: Column) -> Column:
    return ts.cast("date")


def _stats_columns() -> dict[str, Column]:
    """Columns shared by the campaign and product bindings."""
    return {
        "customer_id": F.col("l_linestatus").alias("customer_id"),
        "date": _as_date(F.col("l_shipdate")).alias("date"),
        "clicks": F.col("l_quantity").cast("bigint").alias("clicks"),
        "cost_micros": (F.round(F.col("l_extendedprice") * 100).cast("bigint") * 10000).alias(
            "cost_micros"
        ),
        "conversions": F.col("l_discount").cast(MONEY).alias("conversions"),
    }


def campaign_stats(lineitem: DataFrame) -> DataFrame:
    """One stats row per line; the campaign is the line's part, so no other table is read."""
    c = _stats_columns()
    value = F.col("l_extendedprice").cast("decimal(16,2)") * F.col("l_linenumber")
    return lineitem.select(
        c["customer_id"],
        F.col("l_partkey").alias("id"),
        c["date"],
        (F.col("l_quantity").cast("bigint") * 100).alias("impressions"),
        c["clicks"],
        c["cost_micros"],
        c["conversions"],
        value.cast(MONEY).alias("conversions_value"),
    )


def campaign_history(orders: DataFrame) -> DataFrame:
    """Every order is a version of the campaign numbered like its customer. Parts outnumber
    customers, so some campaigns have no history."""
    return orders.select(
        F.col("o_custkey").alias("id"),
        F.col("o_orderpriority").alias("name"),
        _as_date(F.col("o_orderdate")).alias("start_date"),
        F.col("o_orderkey").alias("version_id"),
    )


def keyed_products(lineitem: DataFrame, part: DataFrame) -> KeyedProducts:
    """A line's product is its part; a line's conversion value is the part's price."""
    c = _stats_columns()
    facts = lineitem.select(
        c["customer_id"], F.col("l_partkey").alias("product_id"), c["date"], c["clicks"], c["cost_micros"], c["conversions"]
    )
    products = part.select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_title"),
        F.col("p_retailprice").cast(MONEY).alias("conversions_value"),
    )
    return KeyedProducts(facts, products)


def channel_event_report(events: DataFrame) -> DataFrame:
    """One row per event: sessions = event_count = 1, a signup is a new user."""
    return events.select(
        _as_date(F.col("ts")).alias("date"),
        _channel(F.col("user_id")).alias("session_default_channel_group"),
        F.col("event_type").alias("event_name"),
        F.lit(1).cast("bigint").alias("sessions"),
        F.when(F.col("event_type") == "signup", 1).otherwise(0).cast("bigint").alias("new_users"),
        F.lit(1).cast("bigint").alias("event_count"),
        F.col("value").cast(MONEY).alias("total_revenue"),
    )


def channel_session_report(events: DataFrame) -> DataFrame:
    """Per date and channel: sessions = events, total_users = distinct users."""
    return (
        events.select(
            _as_date(F.col("ts")).alias("date"),
            _channel(F.col("user_id")).alias("session_default_channel_grouping"),
            F.col("user_id"),
        )
        .groupBy("date", "session_default_channel_grouping")
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.countDistinct("user_id").alias("total_users"),
        )
    )


def channel_event_report_long(lineitem: DataFrame) -> DataFrame:
    """A several-year event report (``events`` spans one month only) for the monthly report."""
    return lineitem.select(
        _as_date(F.col("l_shipdate")).alias("date"),
        _channel(F.col("l_linenumber")).alias("session_default_channel_group"),
        F.lit("line").alias("event_name"),
        F.col("l_quantity").cast("bigint").alias("sessions"),
        F.col("l_linenumber").cast("bigint").alias("new_users"),
        F.lit(1).cast("bigint").alias("event_count"),
        F.col("l_extendedprice").cast(MONEY).alias("total_revenue"),
    )


class BoundTables:
    """The logical tables over one directory of the driver's files.

    Each table is defined on first use and reused within this object, so the reports of
    one call share a file listing. The next call lists the files anew.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = raw(self.spark, self.sf_dir, name)
        return self._raw[name]

    @cached_property
    def campaign_stats(self) -> DataFrame:
        return campaign_stats(self.raw("lineitem"))

    @cached_property
    def campaign_history(self) -> DataFrame:
        return campaign_history(self.raw("orders"))

    @cached_property
    def products(self) -> KeyedProducts:
        return keyed_products(self.raw("lineitem"), self.raw("part"))

    @cached_property
    def product_stats(self) -> DataFrame:
        return self.products.rows()

    @cached_property
    def channel_session_report(self) -> DataFrame:
        return channel_session_report(self.raw("events"))

    @cached_property
    def channel_event_report(self) -> DataFrame:
        return channel_event_report(self.raw("events"))

    @cached_property
    def channel_event_report_long(self) -> DataFrame:
        return channel_event_report_long(self.raw("lineitem"))


def bind_tables(spark: SparkSession, sf_dir: str) -> BoundTables:
    """The logical tables over the Parquet files that are at ``sf_dir`` now."""
    return BoundTables(spark, sf_dir.rstrip("/"))
