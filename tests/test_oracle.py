"""Every registered query equals its DuckDB oracle exactly (the driver's gate), plus the
FIXTURES golden values and the entry smoke check."""

import pytest

from conftest import SF001, SF01


@pytest.fixture(scope="module")
def results(spark):
    from kpiloom.checks import compare
    from kpiloom.registry import QUERIES

    return compare(spark, SF01, list(QUERIES))


def test_every_query_has_an_oracle():
    from __spark_entry__ import oracle_sql, queries
    from kpiloom.oracle import oracle_sql as own_oracle
    from kpiloom.registry import QUERIES

    assert set(QUERIES) == set(own_oracle())
    assert set(QUERIES) <= set(queries()) and set(own_oracle()) <= set(oracle_sql()) <= set(queries())


def test_all_queries_match_oracle(results):
    bad = {k: v for k, v in results.items() if v[0] != "ok"}
    assert not bad, bad


def test_queries_are_non_empty(results):
    assert all(v[1] > 0 for v in results.values()), results


def test_entry_smoke(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert df.columns[0] == "google_ads_total_cost"


def test_smoke_scale_matches_oracle(spark):
    from kpiloom.checks import compare

    res = compare(spark, SF001, ["account_totals", "organic_daily_compare", "segment_totals"])
    assert all(v[0] == "ok" for v in res.values()), res


def _one(spark, name):
    from __spark_entry__ import queries

    return queries()[name](spark, SF01).collect()


def test_golden_account(spark):
    (r,) = _one(spark, "account_totals")
    assert (r.impressions, r.clicks) == (971900, 9719)
    assert r.cost == 20393849.6
    assert round(r.conversions, 2) == 18.63
    assert round(r.conversion_value, 2) == 80888786.96


def test_golden_segments(spark):
    rows = {r.segment: r for r in _one(spark, "segment_totals")}
    assert rows["shopping"].impressions == 167700
    assert rows["search"].impressions == 585400
    assert rows["trailing_year"].clicks == 53930
    assert rows["trailing_year"].cost == 112292279.86
    assert round(rows["trailing_year"].conversions, 2) == 110.92


def test_golden_known_and_versions(spark):
    (k,) = _one(spark, "known_campaign_totals")
    assert k.total_cost == 15250854.74 and round(k.total_conversions, 2) == 14.21
    conv = {r.campaign: round(r.conversions, 2) for r in _one(spark, "conversions_by_campaign_version")}
    assert conv == {"1-URGENT": 29.16, "2-HIGH": 28.63, "3-MEDIUM": 28.48,
                    "4-NOT SPECIFIED": 26.52, "5-LOW": 29.87}
    perf = {r.campaign_name: (r.cost, round(r.conversions, 2)) for r in _one(spark, "campaign_performance")}
    assert perf["1-URGENT"] == (3395707.79, 3.22)
    assert perf["3-MEDIUM"] == (3717741.42, 3.43)


def test_golden_products_and_daily(spark):
    products = _one(spark, "product_performance")
    assert len(products) == 64
    assert max(r.cost for r in products) == 1062993.15
    daily = _one(spark, "account_daily")
    assert len(daily) == 31
    assert round(sum(r.conversion_value for r in daily), 2) == 80888786.96


def test_golden_organic(spark):
    (s,) = _one(spark, "session_totals")
    assert (s.total_ga4_sessions, s.total_ga4_total_users) == (2532, 1017)
    (p,) = _one(spark, "purchase_totals")
    assert p.total_seo_sales == 493 and round(p.total_ga4_seo_revenue, 2) == 23813.70
    (o,) = _one(spark, "organic_summary")
    assert (o.ga4_sessions, o.ga4_new_users, o.key_events) == (2532, 501, 2532)
    assert round(o.ga4_total_revenue, 2) == 126553.13


def test_golden_daily_compare(spark):
    faithful = _one(spark, "organic_daily_compare")
    aligned = _one(spark, "organic_daily_compare_aligned")
    assert len(faithful) == 16 and len(aligned) == 15
    only_prev = [r for r in faithful if r.key_events == 0 and r.key_events_previous_period > 0]
    only_cur = [r for r in faithful if r.key_events > 0 and r.key_events_previous_period == 0]
    assert len(only_prev) == 1 and len(only_cur) == 1
    for rows in (faithful, aligned):
        assert sum(r.key_events for r in rows) == 2532
        assert sum(r.key_events_previous_period for r in rows) == 2577
        assert round(sum(r.ga4_total_revenue_previous_period for r in rows), 2) == 129928.71


def test_golden_monthly(spark):
    rows = _one(spark, "organic_monthly")
    assert len(rows) == 13
    assert sum(r.ga4_sessions for r in rows) == 97908
    assert min(r.ga4_sessions for r in rows) == 2667
    assert max(r.ga4_sessions for r in rows) == 9260
    assert sum(r.ga4_new_users for r in rows) == 12744
    assert round(sum(r.ga4_total_revenue for r in rows), 2) == 199234859.69
