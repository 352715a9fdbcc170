import os
import sys
import tempfile
from datetime import date
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]")
        .appName("kpiloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from kpiloom.session import checkpoint_dir

    # Tests only: no cluster folder is configured, so use a fresh local one.
    checkpoint_dir(s, fallback=tempfile.mkdtemp(prefix="kpiloom-test-ckpt-"))
    yield s
    s.stop()


def D(s: str) -> date:
    return date.fromisoformat(s)


def M(x) -> Decimal | None:
    return None if x is None else Decimal(str(x)).quantize(Decimal("0.01"))


@pytest.fixture()
def make(spark):
    """Build a logical table from tuples in contract column order."""
    from kpiloom.sources.tables import SCHEMAS

    def _make(table, rows):
        return spark.createDataFrame(rows, SCHEMAS[table])

    return _make


def stats_row(customer="C", id=1, day="2024-03-10", impressions=100, clicks=10,
              cost_micros=5_000_000, conversions=1, value=20):
    return (customer, id, D(day), impressions, clicks, cost_micros, M(conversions), M(value))


def hist_row(id=1, name="Brand", start="2024-01-01", version=1):
    return (id, name, None if start is None else D(start), version)
