"""Maintained tables: the latest-version state, restated days and monthly rollups equal the batch
results, whatever the order of arrival and the range."""

import os
import random
from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF001, hist_row, stats_row
from kpiloom import Period, ReportConfig
from kpiloom.operators import ads, organic
from kpiloom.operators.dims import latest_campaign
from kpiloom.period import last_12_months, trailing_year
from kpiloom.plans import latest_state, months
from kpiloom.plans.rollup import daily_rollup
from kpiloom.plans.segments import segment_totals
from kpiloom.sources.bindings import bind_tables
from kpiloom.sources.files import read_json
from kpiloom.sources.tables import CAMPAIGN_STATS
from kpiloom.streaming.rollup_stream import batch_writer, compact, read_stream_rollup


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- the newest version per id -------------------------------------------------------------

def versions(seed, n=120):
    rnd = random.Random(seed)
    return [
        hist_row(rnd.choice([None, *range(25)]), rnd.choice(["a", "b", "c", None]), rnd.choice([None, "2024-01-01", "2024-02-01", "2023-05-05"]),
                 rnd.choice([None, 1, 2, 3]))
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_state_equals_latest_campaign_in_any_order(spark, make, tmp_path, seed):
    rnd = random.Random(seed)
    all_rows = versions(seed)
    want = rows(latest_campaign(make("campaign_history", all_rows)))
    parts = [all_rows[i::4] for i in range(4)]
    arrivals = [*parts, parts[0], []]
    rnd.shuffle(arrivals)
    root = f"{tmp_path}/state"
    for part in arrivals:
        latest_state.merge_latest(spark, root, make("campaign_history", part).repartition(3), buckets=5)
    assert rows(latest_state.read_latest(spark, root)) == want


def test_merge_rewrites_only_the_buckets_of_the_arrivals(spark, make, tmp_path):
    root = f"{tmp_path}/state"
    first = latest_state.merge_latest(spark, root, make("campaign_history", [hist_row(i, f"n{i}") for i in range(200)]), buckets=8)
    before = read_json(spark, f"{root}/_buckets.json")["folders"]
    touched = latest_state.merge_latest(spark, root, make("campaign_history", [hist_row(7, "new", "2025-01-01")]), buckets=99)
    after = read_json(spark, f"{root}/_buckets.json")["folders"]
    assert first == list(range(8)) and len(touched) == 1 and {b for b in after if after[b] != before[b]} == {str(touched[0])}
    assert dict(latest_state.read_latest(spark, root).collect())[7] == "new"
    held = latest_state.read_latest(spark, root)
    latest_state.merge_latest(spark, root, make("campaign_history", [hist_row(7, "newer", "2026-01-01")]))
    assert dict(held.collect())[7] == "new"  # a reader of the former state still finds its folders
    assert not [f for f in os.listdir(root) if f.startswith("arrivals")]


def test_failing_merge_leaves_the_state(spark, make, tmp_path):
    root = f"{tmp_path}/state"
    latest_state.merge_latest(spark, root, make("campaign_history", [hist_row(1, "a"), hist_row(2, "b")]), buckets=4)
    bad = make("campaign_history", [hist_row(1, "c", "2025-01-01"), hist_row(2, "d", "2025-01-01")]).withColumn("name", F.expr("assert_true(id < 2, 'lost')").cast("string"))
    with pytest.raises(Exception, match="lost"):
        latest_state.merge_latest(spark, root, bad)
    assert rows(latest_state.read_latest(spark, root)) == [(1, "a"), (2, "b")]
    assert sorted(f.split("-")[0] for f in os.listdir(root) if not f.startswith(".")) == ["_buckets.json", "merge"]


def test_empty_state_and_stream(spark, make, tmp_path):
    assert latest_state.read_latest(spark, f"{tmp_path}/none").collect() == []
    src, root = f"{tmp_path}/src", f"{tmp_path}/state"
    for part in ([hist_row(1, "a"), hist_row(2, "b")], [hist_row(1, "late", "2020-01-01"), hist_row(3, None, None)]):
        make("campaign_history", part).write.mode("append").parquet(src)
        latest_state.start_latest_stream(spark, src, root, f"{tmp_path}/ckpt", buckets=4).awaitTermination(300)
    assert rows(latest_state.read_latest(spark, root)) == [(1, "a"), (2, "b"), (3, None)]


# --- restated days ---------------------------------------------------------------------------

def statements(seed):
    """(stamp, epoch, account, day, rows): whole days of an account, stated one to four times."""
    rnd = random.Random(seed)
    out, epochs = [], 5
    for account in ("A", "B", None):
        for d in range(1, 7):
            for _ in range(rnd.randint(1, 4)):
                day = f"2024-03-{d:02d}"
                said = [stats_row(account, rnd.choice([1, 2, None]), day, clicks=rnd.randint(1, 99), impressions=1000) for _ in range(rnd.randint(1, 3))]
                if rnd.random() < 0.15:  # stated to be empty
                    said = [(account, None, date.fromisoformat(day), None, None, None, None, None)]
                out.append((rnd.choice([None, 1, 2, 3]), rnd.randrange(epochs), account, day, said))
    return out, epochs


@pytest.mark.parametrize("stamped", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_newest_restatement_wins(spark, make, tmp_path, seed, stamped):
    said, epochs = statements(seed)
    best = {}
    for stamp, epoch, account, day, facts in said:
        key = ((stamp or -1) if stamped else 0, epoch)
        held = best.setdefault((account, day), (key, []))
        if key > held[0]:
            best[account, day] = (key, list(facts))
        elif key == held[0]:
            held[1].extend(facts)  # one statement in two parts
    truth = [r for _, facts in best.values() for r in facts if r[1] is not None or r[4] is not None]
    want = rows(daily_rollup(make("campaign_stats", truth)))
    root = f"{tmp_path}/r"
    write = batch_writer(root, restated=True, stamp="stated" if stamped else None)
    schema = "customer_id string, id long, date date, impressions long, clicks long, cost_micros long, conversions decimal(18,2), conversions_value decimal(18,2), stated long"
    batches = {e: spark.createDataFrame([(*r, s) for s, x, _, _, facts in said if x == e for r in facts], schema).repartition(2) for e in range(epochs)}
    for epoch in range(epochs):
        write(batches[epoch], epoch)
    assert rows(read_stream_rollup(spark, root, restated=True)) == want
    write(batches[epochs - 1], epochs - 1)  # replayed
    assert rows(read_stream_rollup(spark, root, restated=True)) == want
    assert compact(spark, root, keep=2, restated=True) == epochs - 3
    assert rows(read_stream_rollup(spark, root, restated=True)) == want
    assert read_stream_rollup(spark, root, restated=True).columns == CAMPAIGN_STATS.names


# --- months and edge days --------------------------------------------------------------------

DAYS = st.dates(date(2023, 11, 1), date(2025, 3, 31))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(DAYS, DAYS), max_size=3))
def test_decomposition_covers_the_union_once(pairs):
    periods = [Period(a, b) for a, b in pairs]
    whole, days = months.decompose(periods)
    month = lambda d: (d.year, d.month)
    every = [date(2023, 10, 1) + timedelta(days=i) for i in range(600)]
    union = {d for d in every if any(p.start <= d <= p.end for p in periods)}
    by_month = {d for d in every if d.replace(day=1) in whole}
    by_day = [d for d in every for p in days if p.start <= d <= p.end]
    assert by_month | set(by_day) == union and not by_month & set(by_day) and len(by_day) == len(set(by_day))
    for first in whole:  # each period holds all of a whole month or nothing of it
        inside = [d for d in every if month(d) == month(first)]
        assert all(len({p.start <= d <= p.end for d in inside}) == 1 for p in periods if p.start <= p.end)


@pytest.mark.parametrize("today", [date(2024, 3, 1), date(2024, 3, 2), date(2025, 1, 1), date(2023, 7, 17), date(2024, 12, 31)])
def test_a_year_is_twelve_months_and_few_days(today):
    for period in (trailing_year(today), last_12_months(today)):
        whole, days = months.decompose([period])
        assert len(whole) <= 12 and sum((p.end - p.start).days + 1 for p in days) <= 60


@pytest.fixture(scope="module")
def rollups(spark):
    daily = daily_rollup(bind_tables(spark, SF001).campaign_stats).cache()
    yield months.Rollups(daily, months.monthly(daily).cache())
    daily.unpersist()


def test_random_ranges_give_identical_sums(spark, rollups):
    t = bind_tables(spark, SF001)
    rnd = random.Random(6)
    for _ in range(4):
        start = date(1996, 1, 1) + timedelta(days=rnd.randint(0, 700))
        period = Period(start, start + timedelta(days=rnd.choice([0, 27, 45, 200, 700])))
        rows_of = months.stats_over(rollups, period)
        assert rows(ads.account_totals(rows_of, period, "O")) == rows(ads.account_totals(t.campaign_stats, period, "O"))
        assert rows(ads.campaign_performance(rows_of, t.campaign_history, period, "O")) == rows(
            ads.campaign_performance(t.campaign_stats, t.campaign_history, period, "O"))


def test_segments_over_two_periods_that_cut_months(spark, rollups):
    t = bind_tables(spark, SF001)
    config, today = ReportConfig(customer_id="O", shopping_pattern="%URGENT%", excluded_patterns=("%HIGH%",)), date(1999, 1, 2)
    for period in (Period(date(1998, 3, 10), date(1998, 4, 20)), Period(date(1997, 12, 20), date(1998, 1, 31))):
        rows_of = months.stats_over(rollups, period, trailing_year(today))
        assert rows(segment_totals(rows_of, t.campaign_history, period, config, today)) == rows(
            segment_totals(t.campaign_stats, t.campaign_history, period, config, today))


def test_a_year_reads_few_rows_of_an_id(spark, rollups):
    most = months.stats_over(rollups, trailing_year(date(1998, 7, 15))).groupBy("customer_id", "id").agg(F.count("*").alias("n"), F.countDistinct("date").alias("d"))
    assert most.agg(F.max("n")).first()[0] <= 12 + 60
    day_rows = months.stats_over(rollups, trailing_year(date(1998, 7, 15))).where("dayofmonth(date) > 1")
    assert day_rows.select("date").distinct().count() <= 60


def test_monthly_events(spark):
    long = bind_tables(spark, SF001).channel_event_report_long
    rolled = months.event_rollups(long)
    for today in (date(1999, 3, 10), date(1998, 6, 30)):
        assert rows(organic.organic_monthly(months.stats_over(rolled, last_12_months(today)), today, ("Organic Search",))) == rows(
            organic.organic_monthly(long, today, ("Organic Search",)))
