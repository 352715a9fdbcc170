"""``with_position`` over many partitions equals a plain Python enumeration."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from kpiloom.functions.ordering import By, with_position


def test_global_positions(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.randint(0, 500), rnd.choice(["a", "B", None])) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, k int, s string").repartition(17)
    got = with_position(df, [By(F.col("k"), ascending=False), F.col("id")]).collect()
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [r.id for r in sorted(got, key=lambda r: r.position)] == [r[0] for r in want]
    assert sorted(r.position for r in got) == list(range(1, len(rows) + 1))
    # Rows come back in position order.
    assert [r.position for r in got] == list(range(1, len(rows) + 1))


def test_positions_restart_per_group(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["x", "y", "z", None]), rnd.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(9)
    got = with_position(df, [F.col("v"), F.col("id")], partition_by=["g"]).collect()
    by_group = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        by_group.setdefault(r[1], []).append(r[0])
    want = {i: pos for ids in by_group.values() for pos, i in enumerate(ids, start=1)}
    assert {r.id: r.position for r in got} == want


def test_empty_input(spark):
    df = spark.createDataFrame([], "id long, g string")
    assert with_position(df, [F.col("id")]).count() == 0
    assert with_position(df, [F.col("id")], partition_by=["g"]).count() == 0


@pytest.mark.parametrize("buckets", [1, 2, 3, 50, 400])
@pytest.mark.parametrize("ascending, nulls_last", [(True, True), (True, False), (False, True), (False, False)])
def test_equal_to_row_number_on_ties_nulls_and_skew(spark, buckets, ascending, nulls_last):
    """A third of all rows tie on the first key, a third are NULL there; NaN and infinities sort as
    Spark sorts them. The key is total, so row_number() has one answer."""
    from pyspark.sql import Window

    special = [float("nan"), float("inf"), float("-inf"), 0.0, -0.0]
    rnd = random.Random(buckets)
    rows = [(i, rnd.choice([7.0, None, rnd.choice([rnd.random(), *special])]), rnd.choice(["é", "z", "", None])) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, v double, s string").repartition(7)
    order = [By(F.col("v"), ascending, nulls_last), By(F.col("s"), not ascending, nulls_last), F.col("id")]
    sorts = [o.sort() if isinstance(o, By) else o.asc_nulls_last() for o in order]
    want = df.withColumn("position", F.row_number().over(Window.orderBy(*sorts)))
    got = [r.id for r in with_position(df, order, buckets=buckets).collect()]
    assert got == [r.id for r in want.orderBy("position").collect()]


def test_rows_tied_on_every_part_spread_over_buckets(spark):
    df = spark.range(4000).selectExpr("id", "1 AS k", "'same' AS s").repartition(6)
    got = with_position(df, [F.col("k"), F.col("s")], buckets=8)
    assert sorted(r.position for r in got.collect()) == list(range(1, 4001))
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 4000 / 3
    again = {r.id: r.position for r in with_position(df.repartition(3), [F.col("k"), F.col("s")], buckets=8).collect()}
    assert {r.id: r.position for r in got.collect()} == again  # ties have one order, whatever the partitioning


def _jobs_of(spark, build):
    """Number of Spark jobs that ``build`` runs."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "build")
    try:
        out = build()
        return out, len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_building_runs_no_job_and_writes_nothing(spark, tmp_path):
    from datetime import date

    from kpiloom import Period
    from kpiloom.operators import present
    from kpiloom.plans import dashboards
    from kpiloom.registry import ADS_TODAY, CONFIG
    from conftest import SF001
    from kpiloom.sources.bindings import bind_tables

    path = f"{tmp_path}/t"
    spark.range(100).selectExpr("id AS name", "rand(3) AS cost").write.parquet(path)
    df = spark.read.schema("name long, cost double").parquet(path)
    sorted_report, jobs = _jobs_of(spark, lambda: present.sort_report(df, "cost", ascending=False))
    assert jobs == 0 and "Scan ExistingRDD" not in sorted_report._jdf.queryExecution().executedPlan().toString()
    tables = bind_tables(spark, SF001)
    tables.campaign_stats, tables.campaign_history, tables.products  # the files' schemas are read here
    page, jobs = _jobs_of(spark, lambda: dashboards.ads_page(tables, Period(date(1998, 1, 1), date(1998, 1, 31)), CONFIG, ADS_TODAY))
    assert jobs == 0 and page.scratch == [] and len(page) == 9
    daily, jobs = _jobs_of(spark, lambda: page["account_daily"])
    assert jobs > 0 and len(page.scratch) == 1  # the one shared table that it reads
    page.close()


def test_the_report_is_computed_once(spark):
    """Bounds, offsets and rows read one shuffled report: its exchange is reused by the subqueries."""
    from conftest import SF001
    from __spark_entry__ import queries

    df = queries()["sort_report"](spark, SF001)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().replace("\n", " ")
    final = re.sub(r"== Initial Plan ==.*?(?=Subquery|== Final Plan ==|$)", " ", plan)
    assert final.count("ReusedExchange") >= 2
