"""Hand-made rows for the null, ordering and boundary rules (FIXTURES part C)."""

from datetime import date

import pytest

from conftest import D, M, hist_row, stats_row
from kpiloom import ReportConfig
from kpiloom.operators import ads, organic, overview, present
from kpiloom.period import Period, previous_month, resolve_period
from kpiloom.plans.segments import segment_totals
from kpiloom.sources.tables import Tables

P = Period(D("2024-03-01"), D("2024-03-31"))
CFG = ReportConfig(customer_id="C")


def event_row(day="2024-03-10", channel="Organic Search", event="purchase", sessions=1,
              new_users=0, count=1, revenue=10):
    return (D(day), channel, event, sessions, new_users, count, M(revenue))


def session_row(day="2024-03-10", channel="Organic Search", sessions=5, users=3):
    return (D(day), channel, sessions, users)


@pytest.fixture()
def tables(make):
    def _tables(stats=(), history=(), events=(), sessions=(), products=()):
        return Tables(
            campaign_stats=make("campaign_stats", list(stats)),
            campaign_history=make("campaign_history", list(history)),
            product_stats=make("product_stats", list(products)),
            channel_session_report=make("channel_session_report", list(sessions)),
            channel_event_report=make("channel_event_report", list(events)),
        )

    return _tables


def test_empty_period(tables):
    t = tables(stats=[stats_row(day="2023-01-01")], history=[hist_row()],
               events=[event_row(day="2023-01-01")], sessions=[session_row(day="2023-01-01")])
    (r1,) = overview.marketing_overview(t, P, CFG).collect()
    assert all(v == 0 for v in r1.asDict().values())
    (v1,) = overview.marketing_overview(t, P, CFG, null_policy="keep").collect()
    d = v1.asDict()
    for k in ("google_ads_total_cost", "google_ads_total_conversions", "google_ads_total_revenue",
              "ga4_total_sessions", "ga4_total_users"):
        assert d.pop(k) is None
    assert all(v == 0 for v in d.values()), d
    (r2,) = ads.account_totals(t.campaign_stats, P, "C").collect()
    assert all(v == 0 for v in r2.asDict().values())
    (r10,) = organic.organic_summary(t.channel_session_report, t.channel_event_report, P,
                                     CFG.channels).collect()
    assert r10.ga4_sessions is None
    assert (r10.ga4_new_users, r10.ga4_total_revenue, r10.key_events) == (0, 0.0, 0)
    assert ads.account_daily(t.campaign_stats, P, "C").count() == 0
    assert ads.campaign_performance(t.campaign_stats, t.campaign_history, P, "C").count() == 0
    assert ads.conversions_by_campaign_version(t.campaign_stats, t.campaign_history, P, "C").count() == 0
    assert organic.organic_daily_compare(t.channel_event_report, P, CFG.channels).count() == 0


def test_null_measure(tables):
    t = tables(stats=[stats_row(value=None)], history=[hist_row()])
    (r2,) = ads.account_totals(t.campaign_stats, P, "C").collect()
    assert r2.conversion_value == 0 and r2.roas == 0 and r2.clicks == 10
    (r8,) = ads.campaign_performance(t.campaign_stats, t.campaign_history, P, "C").collect()
    assert r8.conversion_value is None and r8.conversion_value_cost_ratio is None


def test_zero_negative_null_denominators(tables):
    t = tables(stats=[stats_row(impressions=0, clicks=0, cost_micros=-5, conversions=None)])
    (r2,) = ads.account_totals(t.campaign_stats, P, "C").collect()
    assert (r2.cpc, r2.conversion_cost, r2.roas, r2.ctr, r2.conv_rate) == (0.0,) * 5
    (d,) = ads.account_daily(t.campaign_stats, P, "C").collect()
    assert d.cost_per_conversion == 0.0


def test_fractional_conversions(tables):
    t = tables(stats=[stats_row(clicks=4, conversions=2.5)])
    (r2,) = ads.account_totals(t.campaign_stats, P, "C").collect()
    assert r2.conv_rate == 0.625


def test_version_tie_and_null_start(tables, make):
    from kpiloom.operators.dims import latest_campaign

    h = make("campaign_history", [
        hist_row(1, "old", "2024-01-01", 1), hist_row(1, "new", "2024-01-01", 2),
        hist_row(2, "dated", "2024-02-01", 1), hist_row(2, "undated", None, 2),
        hist_row(3, "b", "2024-01-01", None), hist_row(3, "a", "2024-01-01", None),
    ])
    got = {r.id: r.name for r in latest_campaign(h).collect()}
    assert got == {1: "new", 2: "undated", 3: "a"}


def test_id_without_history_and_null_name(tables):
    stats = [stats_row(id=1, conversions=1), stats_row(id=2, conversions=2), stats_row(id=3, conversions=4)]
    history = [hist_row(1, "Shopping A"), hist_row(3, None)]  # id 2 has none, id 3 NULL name
    t = tables(stats=stats, history=history)
    acc = ads.account_totals(t.campaign_stats, P, "C").first()
    assert acc.conversions == 7
    known = ads.known_campaign_totals(t.campaign_stats, t.campaign_history, P, "C").first()
    assert known.total_conversions == 5  # ids 1 and 3
    shop = ads.shopping_totals(t.campaign_stats, t.campaign_history, P, "C").first()
    search = ads.search_totals(t.campaign_stats, t.campaign_history, P, "C").first()
    assert shop.conversions == 1 and search.conversions == 0
    perf = {r.campaign_name: r.conversions
            for r in ads.campaign_performance(t.campaign_stats, t.campaign_history, P, "C").collect()}
    assert perf == {"Shopping A": 1.0, None: 4.0}
    daily = ads.account_daily(t.campaign_stats, P, "C").first()
    assert daily.conversions == 7
    r7 = {r.campaign: r.conversions for r in
          ads.conversions_by_campaign_version(t.campaign_stats, t.campaign_history, P, "C").collect()}
    assert r7 == {"Shopping A": 1.0, None: 4.0}
    year = ads.trailing_year_totals(t.campaign_stats, t.campaign_history, D("2024-04-01"), "C",
                                    ("%Germany%",)).first()
    assert year.conversions == 1  # NULL name fails NOT LIKE; id 2 has no name


def test_case_sensitive_pattern(tables):
    t = tables(stats=[stats_row()], history=[hist_row(1, "shopping lower")])
    assert ads.shopping_totals(t.campaign_stats, t.campaign_history, P, "C").first().clicks == 0
    assert ads.search_totals(t.campaign_stats, t.campaign_history, P, "C").first().clicks == 10


def test_one_name_two_ids_and_fan_out(tables):
    stats = [stats_row(id=1, conversions=1), stats_row(id=2, conversions=2), stats_row(id=3, conversions=5)]
    history = [hist_row(1, "Same"), hist_row(2, "Same"),
               hist_row(3, "v1", "2024-01-01", 1), hist_row(3, "v2", "2024-01-02", 2),
               hist_row(3, "v3", "2024-01-03", 3)]
    t = tables(stats=stats, history=history)
    perf = {r.campaign_name: r.conversions
            for r in ads.campaign_performance(t.campaign_stats, t.campaign_history, P, "C").collect()}
    assert perf == {"Same": 3.0, "v3": 5.0}
    r7 = {r.campaign: r.conversions for r in
          ads.conversions_by_campaign_version(t.campaign_stats, t.campaign_history, P, "C").collect()}
    assert r7 == {"Same": 3.0, "v1": 5.0, "v2": 5.0, "v3": 5.0}
    dedup = {r.campaign: r.conversions for r in ads.conversions_by_campaign_version(
        t.campaign_stats, t.campaign_history, P, "C", dedup=True).collect()}
    assert dedup == {"Same": 3.0, "v3": 5.0}
    # Two versions under one name count twice in the faithful form.
    t2 = tables(stats=[stats_row(id=4, conversions=1)],
                history=[hist_row(4, "X", "2024-01-01", 1), hist_row(4, "X", "2024-01-02", 2)])
    r7b = ads.conversions_by_campaign_version(t2.campaign_stats, t2.campaign_history, P, "C").first()
    assert r7b.conversions == 2.0


def test_last_day_included_and_other_customer_excluded(tables):
    t = tables(stats=[stats_row(day="2024-03-31"), stats_row(day="2024-04-01"),
                      stats_row(customer="X", day="2024-03-10")])
    assert ads.account_totals(t.campaign_stats, P, "C").first().clicks == 10


def test_reversed_dates_select_nothing(tables):
    t = tables(stats=[stats_row()], history=[hist_row()], events=[event_row()])
    rev = Period(D("2024-03-31"), D("2024-03-01"))
    assert ads.account_totals(t.campaign_stats, rev, "C").first().clicks == 0
    assert organic.organic_daily_compare(t.channel_event_report, rev, CFG.channels).count() == 0


def test_one_day_period_compare(tables):
    t = tables(events=[event_row(day="2024-03-09", count=3), event_row(day="2024-03-10", count=5)])
    one = Period(D("2024-03-10"), D("2024-03-10"))
    faithful = organic.organic_daily_compare(t.channel_event_report, one, CFG.channels).collect()
    assert [(r.date, r.key_events, r.key_events_previous_period) for r in faithful] == [
        (D("2024-03-09"), 0, 3), (D("2024-03-10"), 5, 0)]
    aligned = organic.organic_daily_compare(t.channel_event_report, one, CFG.channels,
                                            aligned=True).collect()
    assert [(r.date, r.key_events, r.key_events_previous_period) for r in aligned] == [
        (D("2024-03-10"), 5, 3)]


def test_compare_counts_only_organic_channels(tables):
    t = tables(events=[event_row(channel="Direct"), event_row(channel="Organic Shopping", count=2)])
    (r,) = organic.organic_daily_compare(t.channel_event_report, P, CFG.channels).collect()
    assert r.key_events == 2


def test_monthly_buckets(tables):
    days = ["2023-03-10", "2023-03-31", "2023-07-15", "2024-03-10", "2024-03-11", "2023-03-09"]
    t = tables(events=[event_row(day=d) for d in days])
    rows = organic.organic_monthly(t.channel_event_report, D("2024-03-10"), CFG.channels).collect()
    # 2024 is a leap year: today - 365 days = 2023-03-11, so 2023-03-10 falls outside.
    assert [(r.month, r.key_events) for r in rows] == [
        (D("2023-03-01"), 1), (D("2023-07-01"), 1), (D("2024-03-01"), 1)]


def test_segments_equal_separate_reports(tables):
    stats = [stats_row(id=i, day=d, clicks=i, conversions=i / 10)
             for i in range(1, 6) for d in ("2024-03-05", "2023-06-01")]
    history = [hist_row(1, "Shopping 1"), hist_row(2, "Search Germany"), hist_row(3, None),
               hist_row(4, "Search")]
    t = tables(stats=stats, history=history)
    cfg = ReportConfig(customer_id="C")
    today = D("2024-03-20")
    segs = {r.segment: tuple(r)[1:]
            for r in segment_totals(t.campaign_stats, t.campaign_history, P, cfg, today).collect()}
    assert segs["account"] == tuple(ads.account_totals(t.campaign_stats, P, "C").first())
    assert segs["shopping"] == tuple(
        ads.shopping_totals(t.campaign_stats, t.campaign_history, P, "C").first())
    assert segs["search"] == tuple(
        ads.search_totals(t.campaign_stats, t.campaign_history, P, "C").first())
    assert segs["trailing_year"] == tuple(ads.trailing_year_totals(
        t.campaign_stats, t.campaign_history, today, "C", cfg.excluded_patterns).first())


def test_product_search_literal_text(spark, make):
    rows = [("C", t, D("2024-03-10"), 1, 1_000_000, M(1), M(1))
            for t in ("50% off", "a_b", "axb", "Red Bolt", None)]
    products = make("product_stats", rows)
    perf = ads.product_performance(products, P, "C")
    titles = lambda q: sorted(r.product_title or "" for r in present.product_search(perf, q).collect())
    assert titles("%") == ["50% off"]
    assert titles("_") == ["a_b"]
    assert titles("bolt") == ["Red Bolt"]
    assert titles("none") == []  # a NULL title has no text
    assert len(titles("")) == 5


def test_sort_report_positions(tables):
    stats = [stats_row(id=i, clicks=10, conversions=c) for i, c in ((1, 3), (2, 1), (3, 2), (4, 2))]
    history = [hist_row(1, "b"), hist_row(2, "A"), hist_row(3, "c"), hist_row(4, "D")]
    t = tables(stats=stats, history=history)
    perf = ads.campaign_performance(t.campaign_stats, t.campaign_history, P, "C")
    by_rate = present.sort_report(perf, "conversion_rate", ascending=False).collect()
    assert [(r.campaign_name, r.position) for r in sorted(by_rate, key=lambda r: r.position)] == [
        ("b", 1), ("D", 2), ("c", 3), ("A", 4)]
    by_name = present.sort_report(perf, "campaign_name", ascending=True).collect()
    assert [r.campaign_name for r in sorted(by_name, key=lambda r: r.position)] == ["A", "b", "c", "D"]


def test_cards_display(tables):
    t = tables(stats=[stats_row(clicks=1234567, impressions=2_000_000, cost_micros=1_234_565_000_000,
                                conversions=2.5, value=7)],
               history=[hist_row()])
    seg = segment_totals(t.campaign_stats, t.campaign_history, P, CFG)
    cards = {(r.section, r.key): r for r in
             present.metric_cards(seg, "ads", "s", present.ADS_CARD_KEYS, present.ADS_FORMATS).collect()}
    assert cards[("s", "clicks")].display == "1,234,567"
    assert cards[("s", "cost")].display == "£1,234,565.00"
    assert cards[("s", "conversions")].display == "2"  # {:,.0f} of 2.5 rounds half-even
    assert cards[("s", "roas")].label == "Roas"
    assert cards[("s", "conversion_cost")].label == "Conversion Cost"


def test_display_matches_python_format(spark):
    import random

    from kpiloom.functions.formatting import FORMATS, display_sql

    rnd = random.Random(7)
    values = [2.675, 0.125, 1234.565, -1234.5, 0.0, 1e9 + 0.005, 2.5, 3.5, 0.005]
    values += [round(rnd.uniform(-1e7, 1e7), rnd.randint(0, 4)) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for kind, fmt in FORMATS.items():
        got = [r[0] for r in df.selectExpr(display_sql("v", kind)).collect()]
        scale = 100.0 if kind == "percent" else 1.0
        want = [fmt.format(v * scale) for v in values]
        assert got == want, kind
    (none,) = spark.createDataFrame([(None,)], "v double").selectExpr(display_sql("v", "currency")).first()
    assert none == ""


def test_conform_keeps_fractional_double_measures(spark):
    from kpiloom.sources.tables import SchemaError, conform

    raw = spark.createDataFrame(
        [("C", 1, D("2024-03-10"), 10, 3, 1_000_000, 1 / 3, 2.0)] * 3,
        "customer_id string, id long, date date, impressions int, clicks int, "
        "cost_micros long, conversions double, conversions_value double",
    )
    stats = conform(raw, "campaign_stats")
    assert dict(stats.dtypes)["conversions"] == "double"
    assert dict(stats.dtypes)["impressions"] == "bigint"
    (r,) = ads.account_totals(stats, P, "C").collect()
    assert abs(r.conversions - 1.0) < 1e-12 and abs(r.conv_rate - 1 / 9) < 1e-12
    with pytest.raises(SchemaError):
        conform(raw.drop("clicks"), "campaign_stats")


def test_next_sort_toggle():
    assert present.next_sort(None, None, "cost") is True
    assert present.next_sort("cost", True, "cost") is False
    assert present.next_sort("cost", False, "cost") is True
    assert present.next_sort("cost", False, "conversions") is True


def test_resolve_period_defaults():
    today = date(2024, 3, 1)
    assert resolve_period(None, None, today) == Period(D("2024-02-01"), D("2024-02-29"))
    assert resolve_period("2024-13-01", "2024-03-10", today) == previous_month(today)
    assert resolve_period("2024-03-01", None, today) == previous_month(today)
    assert resolve_period("2024-03-05", "2024-03-01", today) == Period(D("2024-03-05"), D("2024-03-01"))
    assert previous_month(date(2024, 1, 15)) == Period(D("2023-12-01"), D("2023-12-31"))


def test_read_jdbc_partitions_by_date(spark, monkeypatch):
    """Option wiring of the partitioned JDBC read (no database is contacted)."""
    from kpiloom.sources import tables as tables_mod

    seen = {}

    class Reader:
        def format(self, fmt):
            seen["format"] = fmt
            return self

        def option(self, key, value):
            seen[key] = value
            return self

        def load(self):
            return spark.createDataFrame([], tables_mod.CHANNEL_SESSION_REPORT)

    class FakeSpark:
        read = Reader()

    df = tables_mod.read_jdbc(FakeSpark(), "jdbc:postgresql://db/x", "ga4.sessions",
                              "channel_session_report", {"user": "u"},
                              lower_bound="2024-01-01", upper_bound="2024-12-31",
                              num_partitions=24)
    assert seen == {"format": "jdbc", "url": "jdbc:postgresql://db/x", "dbtable": "ga4.sessions",
                    "user": "u", "partitionColumn": "date", "lowerBound": "2024-01-01",
                    "upperBound": "2024-12-31", "numPartitions": "24"}
    assert df.columns == [f.name for f in tables_mod.CHANNEL_SESSION_REPORT.fields]
    with pytest.raises(ValueError, match="single_partition"):
        tables_mod.read_jdbc(FakeSpark(), "u", "t", "channel_session_report")
    seen.clear()
    tables_mod.read_jdbc(FakeSpark(), "u", "t", "channel_session_report", single_partition=True)
    assert "partitionColumn" not in seen


def test_display_number_reads_like_the_table_sort(spark):
    from pyspark.sql import functions as F

    from kpiloom.functions.formatting import display_number

    cases = {"£1,234.50": 1234.5, "12.34%": 12.34, "2.67x": 2.67, "-5": -5.0, "": 0.0,
             "None": 0.0, "1.2.3": 1.2, "1-2": 1.0, "--1": 0.0, "-.5": -0.5, " 7 ": 7.0}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.v for r in df.select("t", display_number(F.col("t")).alias("v")).collect()}
    assert got == cases


def test_appended_files_are_seen_by_the_next_call(spark, tmp_path):
    import shutil

    from conftest import SF001

    from kpiloom.registry import QUERIES

    (tmp_path / "events.parquet").mkdir()
    shutil.copy(f"{SF001}/events.parquet", tmp_path / "events.parquet" / "a.parquet")
    (before,) = QUERIES["purchase_totals"](spark, str(tmp_path)).collect()
    shutil.copy(f"{SF001}/events.parquet", tmp_path / "events.parquet" / "b.parquet")
    (after,) = QUERIES["purchase_totals"](spark, str(tmp_path)).collect()
    assert after.total_seo_sales == 2 * before.total_seo_sales > 0
