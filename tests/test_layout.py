"""Bucketed rollup and latest dimension: campaign reports join without an exchange on id."""

import os
import tempfile

from conftest import SF01
from kpiloom.operators import ads
from kpiloom.operators.dims import latest_campaign
from kpiloom.plans.layout import save_bucketed
from kpiloom.plans.rollup import daily_rollup
from kpiloom.registry import ADS_PERIOD
from kpiloom.sources.bindings import bind_tables


def test_bucketed_tables_need_no_id_shuffle(spark):
    t = bind_tables(spark, SF01)
    root = tempfile.mkdtemp(prefix="kpiloom-layout-")
    save_bucketed(daily_rollup(t.campaign_stats), "kpiloom_test_stats", 8,
                  path=os.path.join(root, "stats"))
    save_bucketed(latest_campaign(t.campaign_history), "kpiloom_test_latest", 8,
                  path=os.path.join(root, "latest"))
    stats, latest = spark.table("kpiloom_test_stats"), spark.table("kpiloom_test_latest")

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        report = ads.campaign_performance(stats, None, ADS_PERIOD, "O", latest=latest)
        plan = report._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, report.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin [id" in plan
    assert "Exchange hashpartitioning(id" not in plan
    want = sorted(map(tuple, ads.campaign_performance(
        t.campaign_stats, t.campaign_history, ADS_PERIOD, "O").collect()))
    assert got == want
