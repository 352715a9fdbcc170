"""Plan shape: pushdown, pruning, shared scans, skew-safe dedup, no unbounded cross products."""

import re

import pytest

from conftest import SF01


def plan(spark, name) -> str:
    from __spark_entry__ import queries

    df = queries()[name](spark, SF01)
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(spark, name) -> str:
    """``explain("formatted")`` text (scan metadata printed in full)."""
    from __spark_entry__ import queries

    df = queries()[name](spark, SF01)
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture()
def no_broadcast(spark):
    """Plans as a large cluster would get them (no table is small enough to broadcast)."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def scans(p: str, table: str) -> int:
    return len(re.findall(rf"FileScan parquet [^\n]*{table}\.parquet", p))


def test_filters_pushed_and_columns_pruned(spark):
    p = formatted(spark, "account_totals")
    assert "EqualTo(l_linestatus,O)" in p
    assert "GreaterThanOrEqual(l_shipdate,1998-01-01T00:00)" in p
    assert "LessThan(l_shipdate,1998-02-01T00:00)" in p
    read = re.search(r"ReadSchema: struct<l_[^>]*>", p).group(0)
    for unused in ("l_tax", "l_returnflag", "l_suppkey", "l_partkey"):
        assert unused not in read


@pytest.mark.parametrize("name", ["account_totals", "account_daily"])
def test_account_reports_read_one_table(spark, no_broadcast, name):
    p = plan(spark, name)
    assert len(re.findall("FileScan", p)) == 1 and "Join" not in p


def test_segments_scan_the_facts_once(spark):
    p = plan(spark, "segment_totals")
    assert scans(p, "lineitem") == 1


def test_daily_compare_is_one_scan_without_outer_join(spark):
    p = plan(spark, "organic_daily_compare")
    assert scans(p, "events") == 1
    assert "FullOuter" not in p


def test_latest_version_is_limited_before_the_shuffle(spark, no_broadcast):
    p = plan(spark, "latest_campaign")
    assert "WindowGroupLimit" in p and "Partial" in p
    partial = p.index("Partial")
    exchange = p.index("Exchange hashpartitioning(id")
    assert exchange < partial  # printed top-down: the partial limit sits below the exchange


def test_stats_summed_per_id_before_dimension_join(spark, no_broadcast):
    p = plan(spark, "campaign_performance")
    join = p.index("SortMergeJoin [id")
    assert "HashAggregate(keys=[id" in p[join:]
    # The per-id aggregate feeds the join directly: no exchange between them.
    left = p[join:].split("HashAggregate(keys=[id", 1)[0]
    assert "Exchange" not in left


def test_existence_join_sits_above_the_per_id_aggregate(spark, no_broadcast):
    p = plan(spark, "known_campaign_totals")
    join = p.index("SortMergeJoin [id")
    below = p[join:]
    # Both join inputs are per-id aggregates: the stats are summed before the id shuffle.
    assert below.count("HashAggregate(keys=[id") >= 2
    assert "LeftSemi" not in p


def test_no_cross_or_nested_loop_joins(spark, no_broadcast):
    from kpiloom.registry import QUERIES

    for name in QUERIES:
        p = plan(spark, name)
        assert "CartesianProduct" not in p, name
        assert "BroadcastNestedLoopJoin" not in p, name


def test_positions_use_no_global_window_over_rows(spark):
    p = plan(spark, "sort_report")
    windows = re.findall(r"Window \[[^\n]*", p)
    assert any("_pos_pid" in w for w in windows)
    # The plan is one lazy plan: besides the positions it holds the dedup, partitioned by id.
    assert all("_pos_pid" in w or re.search(r"\], \[id#\d+L\], \[", w) for w in windows), windows


def test_fan_out_join_uses_version_counts(spark, no_broadcast):
    p = plan(spark, "conversions_by_campaign_version")
    # Versions are counted per (id, name) map-side before the shuffle, never joined row by row.
    assert "HashAggregate(keys=[id#" in p and "partial_count(1)" in p
    assert re.search(r"Exchange hashpartitioning\(id#\d+L, name#\d+", p)


def test_page_reports_read_the_shared_input_not_the_facts(spark):
    from kpiloom.plans import dashboards
    from kpiloom.registry import ADS_PERIOD, ADS_TODAY, CONFIG
    from kpiloom.sources.bindings import bind_tables

    page = dashboards.ads_page(bind_tables(spark, SF01), ADS_PERIOD, CONFIG, ADS_TODAY)
    for name, df in page.items():
        p = df._jdf.queryExecution().executedPlan().toString()
        if name == "product_performance":
            continue  # its own fact table
        assert scans(p, "lineitem") == 0, name  # the facts were read once, by the page


@pytest.mark.parametrize("kind", ["string", "bigint", "int"])
def test_account_filter_is_pushed_for_every_id_type(spark, tmp_path, kind):
    from kpiloom.operators import ads
    from kpiloom.registry import ADS_PERIOD
    from kpiloom.sources.bindings import bind_tables
    from kpiloom.sources.tables import read_parquet

    stats = bind_tables(spark, SF01).campaign_stats.selectExpr("if(customer_id = 'O', '7', '8') as customer_id", "* except (customer_id)")
    stats.withColumn("customer_id", stats.customer_id.cast(kind)).write.parquet(f"{tmp_path}/s")
    source = read_parquet(spark, f"{tmp_path}/s", "campaign_stats")
    report = ads.account_totals(source, ADS_PERIOD, "7")
    p = spark._jvm.PythonSQLUtils.explainString(report._jdf.queryExecution(), "formatted")
    assert "EqualTo(customer_id,7)" in p
    assert report.first().clicks == 9719
    assert ads.account_totals(source, ADS_PERIOD, "text").first().clicks == 0


def test_series_are_numbered_before_they_are_spread(spark, no_broadcast):
    p = plan(spark, "chart_series")
    assert "SortMergeJoin [page" not in p and "hashpartitioning(page" not in p


def test_cards_scan_each_table_once(spark, no_broadcast):
    p = plan(spark, "metric_cards")
    assert scans(p, "lineitem") == 1 and scans(p, "orders") == 1
    assert scans(p, "events") == 2  # the session report and the event report


def test_products_are_summed_below_the_join(spark, no_broadcast):
    """Only partial sums per product reach the exchange on the join key, and the join has one row
    a product."""
    for name in ("product_performance", "product_search", "product_table", "sort_products", "sort_products_by_title"):
        p = plan(spark, name)
        exchange = re.search(r"Exchange hashpartitioning\(product_id#\d+L?, \d+\)[^\n]*\n[^\n]*", p[p.index("SortMergeJoin [product_id"):]).group(0)
        below = exchange.split("\n")[1]
        assert "HashAggregate(keys=[product_id" in below and "partial_sum" in below, name


def ancestors(p: str, marker: str) -> list[str]:
    """Plan lines above the first line that holds ``marker``, nearest first."""
    lines = p.split("\n")
    at = next(i for i, line in enumerate(lines) if marker in line)
    depth = lambda line: len(re.match(r"[\s:]*(?:[+:]- )?", line).group(0))
    out, own = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < own:
            out.append(line)
            own = depth(line)
    return out


@pytest.mark.parametrize("name", ["shopping_totals", "search_totals", "trailing_year_totals", "campaign_performance", "conversions_by_campaign_version"])
def test_history_is_reduced_before_its_shuffle(spark, no_broadcast, name):
    """The ids' filter sits below the exchange of the history, and below the partial dedup."""
    p = plan(spark, name)
    above = ancestors(p, "FileScan parquet [o_")
    exchange = next(i for i, line in enumerate(above) if "Exchange hashpartitioning(id#" in line)
    assert any("Filter" in line and "Subquery" in line for line in above[:exchange]), above[: exchange + 1]
    # The filter is not copied to the facts: their per-id sums are the same in both branches.
    assert not any("Subquery" in line for line in p.split("\n") if "FileScan parquet [l_" in line or ("Filter" in line and "l_shipdate" in line))


def test_reduced_reports_scan_the_facts_once(spark, no_broadcast):
    """The ids below the bitmap and the sums below the join are one exchange."""
    from __spark_entry__ import queries

    for name in ("shopping_totals", "campaign_performance", "conversions_by_campaign_version"):
        df = queries()[name](spark, SF01)
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "ReusedExchange" in final and final.count("FileScan parquet [l_") == 1, name
