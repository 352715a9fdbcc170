"""The page's database source: predicates from its periods, and the options of every scan. No
database is started: the reader is replaced by one that records its calls."""

import random
from datetime import date, timedelta

import pytest

from kpiloom import Period, ReportConfig, jobs
from kpiloom.sources import jdbc
from kpiloom.sources.jdbc import Database, date_predicates, date_ranges, id_predicates, page_predicates
from kpiloom.sources.sinks import read_page
from kpiloom.sources.tables import SCHEMAS

CONFIG = ReportConfig(customer_id="123")
MARCH = Period(date(2024, 3, 1), date(2024, 3, 31))
TODAY = date(2024, 4, 10)
NAMES = {t: f"stats.{t}" for t in SCHEMAS}


def days(p):
    return {p.start + timedelta(days=i) for i in range((p.end - p.start).days + 1)}


def test_ranges_cover_each_day_once():
    rnd = random.Random(2)
    for _ in range(200):
        periods = []
        for _ in range(rnd.randint(0, 4)):
            start = date(2024, 1, 1) + timedelta(days=rnd.randint(0, 400))
            periods.append(Period(start, start + timedelta(days=rnd.randint(-3, 120))))
        most = rnd.choice([1, 7, 31, 1000])
        ranges = date_ranges(periods, most)
        listed = [d for r in ranges for d in sorted(days(r))]
        assert listed == sorted(set().union(*map(days, periods))) and all(len(days(r)) <= most for r in ranges)
    with pytest.raises(ValueError):
        date_ranges([MARCH], 0)


def test_predicates_of_a_period():
    assert date_predicates([MARCH], 20, "12'3") == [
        "date >= DATE '2024-03-01' AND date < DATE '2024-03-21' AND customer_id = '12''3'",
        "date >= DATE '2024-03-21' AND date < DATE '2024-04-01' AND customer_id = '12''3'",
    ]
    assert date_predicates([Period(MARCH.end, MARCH.start)], 31) == ["1 = 0"]  # a reversed period selects nothing


@pytest.mark.parametrize("bounds", [(1, 100, 4), (1, 3, 10), (5, 5, 1), (-10, 10, 3), (0, 10**12, 64)])
def test_id_ranges_hold_every_id_once(bounds):
    predicates = id_predicates(bounds)
    low, high, queries = bounds
    assert 1 <= len(predicates) <= queries
    rnd = random.Random(1)
    for i in {low - 5, low, high, high + 5, *(rnd.randint(low, high) for _ in range(50))}:
        assert sum(bool(eval(p.replace("AND", "and").replace("IS NOT NULL", "is not None"), {"id": i})) for p in predicates) == 1


def test_pages_ask_for_their_periods_only():
    db = Database("jdbc:x", NAMES, days=10_000, history_ids=(1, 9, 3))
    ads = page_predicates(db, "ads", MARCH, CONFIG, TODAY)
    # The trailing year ends on 2024-04-09 and holds the period: one range.
    assert ads == {
        "campaign_stats": ["date >= DATE '2023-04-10' AND date < DATE '2024-04-10' AND customer_id = '123'"],
        "product_stats": ["date >= DATE '2024-03-01' AND date < DATE '2024-04-01' AND customer_id = '123'"],
        "campaign_history": ["id < 4", "id >= 4 AND id < 7", "id >= 7"],
    }
    far = Period(date(2020, 1, 1), date(2020, 1, 2))
    assert len(page_predicates(db, "ads", far, CONFIG, TODAY)["campaign_stats"]) == 2  # what lies between is not read
    seo = page_predicates(db, "seo", MARCH, CONFIG, TODAY)
    assert seo == {
        "channel_session_report": ["date >= DATE '2024-03-01' AND date < DATE '2024-04-01'"],
        "channel_event_report": ["date >= DATE '2023-04-11' AND date < DATE '2024-04-11'"],
    }
    assert sorted(page_predicates(db, "overview", MARCH, CONFIG, TODAY)) == [
        "campaign_history", "campaign_stats", "channel_event_report", "channel_session_report"]
    by_month = page_predicates(Database("jdbc:x", NAMES, history_ids=(1, 9, 3)), "ads", MARCH, CONFIG, TODAY)
    assert len(by_month["campaign_stats"]) == 12


def test_the_history_needs_bounds():
    with pytest.raises(ValueError, match="bounds of its ids"):
        page_predicates(Database("jdbc:x", NAMES), "ads", MARCH, CONFIG, TODAY)
    for bad in ((5, 1, 2), (1, 5, 0)):
        with pytest.raises(ValueError, match="history ids"):
            id_predicates(bad)


class Recorder:
    """Stands for ``spark``: rows come from memory, filtered by the predicates as a database would."""

    def __init__(self, spark, rows):
        self.spark, self.rows, self.calls = spark, rows, []
        self.read = self

    def jdbc(self, url, table, predicates=None, properties=None):
        self.calls.append((url, table, predicates, properties))
        df = self.spark.createDataFrame(self.rows[table.split(".")[1]], SCHEMAS[table.split(".")[1]])
        parts = [df.where(p) for p in predicates]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out


def test_the_job_reads_by_predicates(spark, tmp_path, monkeypatch):
    from conftest import hist_row, stats_row

    rows = {
        "campaign_stats": [stats_row(customer="123", id=i % 4, day=f"2024-{m:02d}-{d:02d}") for i, (m, d) in enumerate((m, d) for m in (2, 3, 4) for d in (1, 15, 29))]
        + [stats_row(customer="9", id=1, day="2024-03-01")],
        "campaign_history": [hist_row(i, f"Shopping {i}") for i in range(4)],
        "product_stats": [("123", "Bolt", date(2024, 3, 31), 2, 1_000_000, None, None)],
    }
    fake = Recorder(spark, rows)
    monkeypatch.setattr(jdbc, "read_jdbc", lambda s, *a, **k: _read(fake, *a, **k))

    def _read(fake, url, dbtable, table, properties, predicates):
        from kpiloom.sources.tables import read_jdbc

        return read_jdbc(fake, url, dbtable, table, properties=properties, predicates=predicates)

    (tmp_path / "db.properties").write_text("# the driver's options\n\ndriver = org.example.Driver\nuser=reader\npassword=a=b\n")
    args = ["ads", "--start", "2024-03-01", "--end", "2024-03-31", "--today", "2024-04-10", "--customer-id", "123", "--out", f"{tmp_path}/out",
            "--jdbc-url", "jdbc:example://db/x", "--jdbc-properties", f"{tmp_path}/db.properties", "--history-ids", "0:3:2", "--jdbc-days", "200"]
    for t in ("campaign_stats", "campaign_history", "product_stats"):
        args += [f"--{t.replace('_', '-')}", NAMES[t]]
    jobs.main(args)
    properties = {"driver": "org.example.Driver", "user": "reader", "password": "a=b"}
    assert {c[1] for c in fake.calls} == {NAMES[t] for t in rows} and all(c[0] == "jdbc:example://db/x" and c[3] == properties for c in fake.calls)
    assert {c[1]: c[2] for c in fake.calls} == {NAMES[t]: p for t, p in page_predicates(
        Database("jdbc:x", NAMES, days=200, history_ids=(0, 3, 2)), "ads", MARCH, CONFIG, TODAY).items()}
    assert "a=b" not in repr(Database("jdbc:x", NAMES, properties))
    written = read_page(spark, f"{tmp_path}/out")
    assert [r.day.day for r in written["account_daily"].orderBy("day").collect()] == [1, 15, 29]
    assert written["segment_totals"].where("segment = 'account'").first().clicks == 30
    with pytest.raises(ValueError, match="bounds of its ids"):
        jobs.main([a for a in args if a not in ("--history-ids", "0:3:2")])
    with pytest.raises(ValueError, match="product_stats"):
        jobs.main(args[:-2])
