"""Logical input tables: schemas, readers and a schema check.

Reports never read files themselves; they take the five logical DataFrames below.
Readers return lazy DataFrames so Catalyst can push date / account filters and
column pruning into the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

CAMPAIGN_STATS = T.StructType([
    T.StructField("customer_id", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("date", T.DateType()),
    T.StructField("impressions", T.LongType()),
    T.StructField("clicks", T.LongType()),
    T.StructField("cost_micros", T.LongType()),
    T.StructField("conversions", MONEY),
    T.StructField("conversions_value", MONEY),
])

CAMPAIGN_HISTORY = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("start_date", T.DateType()),
    # Not in the reference: deterministic tie-break between versions with one start_date.
    T.StructField("version_id", T.LongType()),
])

PRODUCT_STATS = T.StructType([
    T.StructField("customer_id", T.StringType()),
    T.StructField("product_title", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("clicks", T.LongType()),
    T.StructField("cost_micros", T.LongType()),
    T.StructField("conversions", MONEY),
    T.StructField("conversions_value", MONEY),
])

CHANNEL_SESSION_REPORT = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("session_default_channel_grouping", T.StringType()),
    T.StructField("sessions", T.LongType()),
    T.StructField("total_users", T.LongType()),
])

CHANNEL_EVENT_REPORT = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("session_default_channel_group", T.StringType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("sessions", T.LongType()),
    T.StructField("new_users", T.LongType()),
    T.StructField("event_count", T.LongType()),
    T.StructField("total_revenue", MONEY),
])

SCHEMAS: dict[str, T.StructType] = {
    "campaign_stats": CAMPAIGN_STATS,
    "campaign_history": CAMPAIGN_HISTORY,
    "product_stats": PRODUCT_STATS,
    "channel_session_report": CHANNEL_SESSION_REPORT,
    "channel_event_report": CHANNEL_EVENT_REPORT,
}

# Columns a source may omit; they are filled with NULL.
OPTIONAL_COLUMNS = {("campaign_history", "version_id")}


class SchemaError(ValueError):
    pass


def _keeps_source_type(contract: T.DataType, source: T.DataType) -> bool:
    """Money measures keep a floating-point or decimal source type: fractional
    conversions (attribution models) may carry more than two decimals, which a cast
    to DECIMAL(18,2) would round away. Integers are cast to the contract decimal."""
    return isinstance(contract, T.DecimalType) and isinstance(
        source, (T.DoubleType, T.FloatType, T.DecimalType)
    )


def _keeps_integral_account(name: str, source: T.DataType) -> bool:
    """A numeric account id keeps its type: a cast of the column would hide the account
    filter from the scan. ``ads.account_rows`` casts the literal instead."""
    return name == "customer_id" and isinstance(source, T.IntegralType)


def conform(df: DataFrame, table: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Project ``df`` onto the contract schema of ``table``; ``keep``: further columns to keep.

    Columns are cast to the contract type, except money measures already stored as
    DOUBLE or DECIMAL and integral account ids, which keep their type. A missing
    required column raises ``SchemaError``. The projection is lazy and prunable.
    """
    schema = SCHEMAS[table]
    present = {c.lower(): c for c in df.columns}
    source_types = {f.name: f.dataType for f in df.schema.fields}
    cols: list[Column] = []
    missing = []
    for field in schema.fields:
        src = present.get(field.name.lower())
        if src is None:
            if (table, field.name) in OPTIONAL_COLUMNS:
                cols.append(F.lit(None).cast(field.dataType).alias(field.name))
                continue
            missing.append(field.name)
            continue
        if _keeps_source_type(field.dataType, source_types[src]) or _keeps_integral_account(field.name, source_types[src]):
            cols.append(F.col(src).alias(field.name))
        else:
            cols.append(F.col(src).cast(field.dataType).alias(field.name))
    if missing:
        raise SchemaError(f"{table}: missing columns {missing}")
    return df.select(*cols, *keep)


@dataclass(frozen=True)
class KeyedProducts:
    """``product_stats`` in two tables: ``facts`` by product id and a product dimension.

    ``facts`` has the columns of ``PRODUCT_STATS`` with ``product_id`` in place of the title and
    without ``conversions_value``, ``products`` has ``product_id``, ``product_title`` and the
    ``conversions_value`` of one fact row. Reports sum the facts per id and join one row per id.
    """

    facts: DataFrame
    products: DataFrame

    def rows(self) -> DataFrame:
        """The logical ``product_stats``: one joined row per fact."""
        return self.facts.join(self.products, "product_id").select(*[f.name for f in PRODUCT_STATS.fields])


@dataclass(frozen=True)
class Tables:
    """The five logical inputs. Any may be ``None`` when a report does not need it."""

    campaign_stats: DataFrame | None = None
    campaign_history: DataFrame | None = None
    product_stats: DataFrame | None = None
    channel_session_report: DataFrame | None = None
    channel_event_report: DataFrame | None = None

    @property
    def products(self) -> DataFrame | KeyedProducts | None:
        """What the product reports read."""
        return self.product_stats


def read_parquet(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Parquet (optionally partitioned by ``date``) conformed to ``table``'s schema."""
    return conform(spark.read.parquet(path), table)


def read_jdbc(
    spark: SparkSession,
    url: str,
    dbtable: str,
    table: str,
    properties: dict[str, str] | None = None,
    partition_column: str = "date",
    lower_bound: str | None = None,
    upper_bound: str | None = None,
    num_partitions: int | None = None,
    predicates: list[str] | None = None,
    single_partition: bool = False,
) -> DataFrame:
    """Read a table over JDBC with caller-supplied connection options.

    With bounds, Spark issues ``num_partitions`` parallel range queries over
    ``partition_column``; with ``predicates``, one query for each. Reading a whole table
    over one connection in one task must be asked for (``single_partition``). Filters on the
    returned DataFrame are pushed into the generated SQL.
    """
    ranged = lower_bound is not None and upper_bound is not None and num_partitions is not None
    if not (ranged or predicates or single_partition):
        raise ValueError(
            f"{table}: give lower_bound, upper_bound and num_partitions, or predicates, or single_partition=True"
        )
    if predicates:
        return conform(spark.read.jdbc(url, dbtable, predicates=predicates, properties=properties or {}), table)
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", dbtable)
    for key, value in (properties or {}).items():
        reader = reader.option(key, value)
    if ranged:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", lower_bound)
            .option("upperBound", upper_bound)
            .option("numPartitions", str(num_partitions))
        )
    return conform(reader.load(), table)


def read_tables(spark: SparkSession, paths: dict[str, str]) -> Tables:
    """Parquet paths keyed by logical table name -> ``Tables``."""
    return Tables(**{name: read_parquet(spark, path, name) for name, path in paths.items()})
