"""The page job: two dates in, report tables out (same numbers as the reports)."""

import os
import tempfile
from datetime import date

import pytest

from conftest import SF01
from kpiloom import jobs
from kpiloom.config import ReportConfig
from kpiloom.operators import ads
from kpiloom.registry import ADS_PERIOD
from kpiloom.sources.bindings import bind_tables
from kpiloom.sources.sinks import read_page

ADS_TABLES = ("campaign_stats", "campaign_history", "product_stats")


@pytest.fixture(scope="module")
def inputs(spark):
    t = bind_tables(spark, SF01)
    root = tempfile.mkdtemp(prefix="kpiloom-job-")
    paths = {}
    for name in ADS_TABLES:
        paths[name] = os.path.join(root, "in", name)
        getattr(t, name).write.parquet(paths[name])
    return root, paths


def _daily_rows(df):
    return sorted(map(tuple, df.collect()))


def test_ads_page_job_writes_reports(spark, inputs):
    root, paths = inputs
    out = os.path.join(root, "out")
    args = ["ads", "--start", "1998-01-01", "--end", "1998-01-31", "--today", "1999-01-02",
            "--customer-id", "O", "--shopping-pattern", "%URGENT%",
            "--excluded-patterns", "%HIGH%,%LOW%", "--out", out]
    for name in ADS_TABLES:
        args += ["--" + name.replace("_", "-"), paths[name]]
    jobs.main(args)
    written = read_page(spark, out)
    assert sorted(written) == sorted([
        "segment_totals", "account_daily", "conversions_by_campaign_version",
        "campaign_performance", "product_performance", "cards", "series", "campaign_table", "product_table"])
    assert written["campaign_table"].where("cost_text like '£%'").count() == 5
    stats = bind_tables(spark, SF01).campaign_stats
    assert _daily_rows(written["account_daily"]) == _daily_rows(
        ads.account_daily(stats, ADS_PERIOD, "O"))


def test_bad_dates_fall_back_to_previous_month(spark, inputs):
    _, paths = inputs
    reports = jobs.page_reports(spark, "ads", paths, ReportConfig(customer_id="O"),
                                "1998-13-01", "1998-02-10", date(1998, 2, 15))
    stats = bind_tables(spark, SF01).campaign_stats
    assert _daily_rows(reports["account_daily"]) == _daily_rows(
        ads.account_daily(stats, ADS_PERIOD, "O"))


def test_missing_tables_are_named(spark, inputs):
    _, paths = inputs
    with pytest.raises(ValueError, match="product_stats"):
        jobs.page_reports(spark, "ads", {k: v for k, v in paths.items() if k != "product_stats"},
                          ReportConfig(customer_id="O"), None, None, date(1998, 2, 15))
