"""Page plans and the materialised rollup give exactly the per-report results."""

import tempfile
from datetime import date

from pyspark.sql import functions as F

from conftest import SF01
from kpiloom.operators import ads, organic
from kpiloom.plans import dashboards
from kpiloom.plans.rollup import daily_rollup, read_rollup, write_rollup
from kpiloom.registry import ADS_PERIOD, ADS_TODAY, CONFIG, ORGANIC_PERIOD
from kpiloom.sources.bindings import bind_tables
from kpiloom.sources.sinks import page_manifest, read_page, write_page, write_reports


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_ads_page_equals_registered_queries(spark):
    from __spark_entry__ import queries

    t = bind_tables(spark, SF01)
    page = dashboards.ads_page(t, ADS_PERIOD, CONFIG, ADS_TODAY)
    qs = queries()
    for name, df in page.items():
        if name in ("cards", "series"):
            both = qs["metric_cards" if name == "cards" else "chart_series"](spark, SF01)
            assert rows(df) == rows(both.where("page = 'ads'")) != [], name
        else:
            assert rows(df) == rows(qs[name](spark, SF01)), name


def test_seo_page_equals_separate_reports(spark):
    t = bind_tables(spark, SF01)
    today = date(2024, 1, 30)
    page = dashboards.seo_page(t, ORGANIC_PERIOD, CONFIG, today)
    assert rows(page["organic_summary"]) == rows(organic.organic_summary(
        t.channel_session_report, t.channel_event_report, ORGANIC_PERIOD, CONFIG.channels))
    assert rows(page["organic_daily_compare"]) == rows(organic.organic_daily_compare(
        t.channel_event_report, ORGANIC_PERIOD, CONFIG.channels))
    assert rows(page["organic_monthly"]) == rows(organic.organic_monthly(
        t.channel_event_report, today, CONFIG.channels))
    assert [r.value for r in page["cards"].orderBy("position").collect()] == [float(v) for v in page["organic_summary"].first()]
    series = page["series"].where("series = 'Daily Key Events'").orderBy("position").collect()
    assert [r.y for r in series] == [float(r.key_events) for r in page["organic_daily_compare"].collect()]
    assert [r.position for r in series] == list(range(1, len(series) + 1))


def test_rollup_is_a_drop_in_campaign_stats(spark):
    t = bind_tables(spark, SF01)
    path = tempfile.mkdtemp(prefix="kpiloom-rollup-") + "/rollup"
    write_rollup(daily_rollup(t.campaign_stats), path)
    rolled = read_rollup(spark, path)
    assert rolled.schema == t.campaign_stats.schema or rolled.columns == t.campaign_stats.columns
    assert rows(ads.account_totals(rolled, ADS_PERIOD, "O")) == rows(
        ads.account_totals(t.campaign_stats, ADS_PERIOD, "O"))
    assert rows(ads.campaign_performance(rolled, t.campaign_history, ADS_PERIOD, "O")) == rows(
        ads.campaign_performance(t.campaign_stats, t.campaign_history, ADS_PERIOD, "O"))
    assert rows(ads.conversions_by_campaign_version(rolled, t.campaign_history, ADS_PERIOD, "O")) == rows(
        ads.conversions_by_campaign_version(t.campaign_stats, t.campaign_history, ADS_PERIOD, "O"))
    # A date filter on the rollup prunes partitions.
    p = ads.account_totals(rolled, ADS_PERIOD, "O")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in p


def test_write_reports(spark):
    t = bind_tables(spark, SF01)
    root = tempfile.mkdtemp(prefix="kpiloom-reports-")
    write_reports({"daily": ads.account_daily(t.campaign_stats, ADS_PERIOD, "O")}, root)
    assert spark.read.parquet(f"{root}/daily").count() == 31


def test_page_tables_are_removed_and_hold_only_the_periods(spark, tmp_path):
    import os

    from kpiloom.period import Period

    t = bind_tables(spark, SF01)
    far = Period(date(1995, 2, 1), date(1995, 2, 28))
    with dashboards.ads_page(t, far, CONFIG, date(2001, 6, 1)) as page:
        assert page.scratch == []  # nothing is computed before a report is asked for
        page["segment_totals"], page["product_table"], page["product_performance"]
        folders = [p.replace("file:", "") for p in page.scratch]
        assert len(folders) == 4 and all(os.path.isdir(f) for f in folders)
        kept = spark.read.parquet(page.scratch[0]).agg({"date": "max"}).first()[0], spark.read.parquet(page.scratch[0]).where(
            "date between '1995-03-01' and '2000-05-30'").count()
        assert kept[1] == 0 and kept[0] > date(2000, 6, 1)
        assert rows(page["account_daily"]) == rows(ads.account_daily(t.campaign_stats, far, "O"))
    assert not any(os.path.exists(f) for f in folders)


def test_names_from_one_history_aggregate(spark, make):
    from conftest import hist_row
    from kpiloom.operators import dims

    history = make("campaign_history", [
        hist_row(1, "a", "2024-01-01", 1), hist_row(1, "b", "2024-01-01", 2), hist_row(1, "a", "2023-01-01", 9),
        hist_row(2, "x", None, 1), hist_row(2, "y", "2024-01-01", 5), hist_row(3, None, "2024-01-01", None), hist_row(3, "z", "2024-01-01", 0),
        hist_row(4, "q", None, 3), hist_row(4, "p", None, 3),
    ])
    both = dims.name_versions(history)
    assert rows(dims.latest_of(both)) == rows(dims.latest_campaign(history))
    assert rows(both.select("id", "name", "n_versions")) == rows(dims.version_names(history))


def test_a_failing_report_leaves_the_former_page(spark, tmp_path):
    import os

    import pytest

    root = f"{tmp_path}/page"
    one = spark.range(3).selectExpr("id", "'old' AS v")
    bad = spark.range(3).selectExpr("id", "assert_true(id < 2, 'lost') AS v")
    with pytest.raises(FileNotFoundError):
        read_page(spark, root)
    first = write_page(spark, {"a": one, "b": one}, root)
    with pytest.raises(Exception, match="lost"):
        write_page(spark, {"a": one.withColumn("v", F.lit("new")), "b": bad}, root)
    page = read_page(spark, root)
    assert page_manifest(spark, root)["version"] == first and sorted(page) == ["a", "b"]
    assert rows(page["a"]) == rows(page["b"]) == rows(one)
    assert os.listdir(f"{root}/versions") == [first]  # what was written of the new version is gone


def test_a_new_page_replaces_the_old_as_a_whole(spark, tmp_path):
    import os

    root = f"{tmp_path}/page"
    version = lambda v: spark.range(2).selectExpr("id", f"'{v}' AS v")
    first = write_page(spark, {"a": version("1"), "gone": version("1")}, root)
    held = read_page(spark, root)
    second = write_page(spark, {"a": version("2")}, root)
    assert rows(held["gone"]) == rows(version("1"))  # a reader of the former version is not cut off
    assert sorted(read_page(spark, root)) == ["a"] and rows(read_page(spark, root)["a"]) == rows(version("2"))
    assert sorted(os.listdir(f"{root}/versions")) == sorted([first, second])
    third = write_page(spark, {"a": version("3")}, root)
    assert sorted(os.listdir(f"{root}/versions")) == sorted([second, third])
    assert page_manifest(spark, root)["before"] == [second]
    assert not [f for f in os.listdir(root) if f.startswith("._manifest") and "crc" not in f]
