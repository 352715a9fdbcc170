"""Page plans: every report of one dashboard page from shared, materialised inputs.

The reference answers the ads page with eight sequential statements, seven of them
scanning the campaign facts and four recomputing the latest-version dedup. Here the
facts of the page's date span are summed once to the (customer_id, id, date) grain,
that small relation is materialised in the cluster's ``spark.checkpoint.dir``, and every
report of the page runs on it. The history of its campaigns is aggregated once to (id, name)
with the number of versions and the newest one; R7's counts and the latest names both come
from it. The product report is computed once for its table too. Reports are unchanged: they
receive a smaller but equivalent ``campaign_stats``.

A page is built when it is read: ``ads_page`` itself runs no job, and a report computes only
the shared tables that it needs, on first use.

pays off when fact scans and the history shuffle dominate, i.e. at scale.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping
from datetime import date
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.config import ReportConfig
from kpiloom.operators import ads, organic, overview, present
from kpiloom.operators.dims import history_of, latest_of, name_versions
from kpiloom.period import Period, last_12_months, previous_period, trailing_year
from kpiloom.plans.rollup import daily_rollup
from kpiloom.plans.segments import segment_totals
from kpiloom.session import checkpoint_dir
from kpiloom.sources.tables import Tables


class Page(Mapping):
    """Reports by name, each built when it is first asked for. ``close`` removes the tables that
    the page materialised; call it when the reports have been written (or use the page in a
    ``with`` block)."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.scratch: list[str] = []
        self._makers: dict[str, Callable[[], DataFrame]] = {}
        self._made: dict[str, DataFrame] = {}

    def report(self, name: str, make: Callable[[], DataFrame]) -> None:
        self._makers[name] = make

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def shared(self, make: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
        """A table of the page that several reports read, materialised on first use."""
        return cache(lambda: self.materialise(make()))

    def materialise(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as a Parquet table in the cluster's checkpoint folder and read it back:
        lineage is cut like ``checkpoint()``, and later reads keep column pruning and filter
        pushdown (a checkpointed RDD is an opaque row scan)."""
        path = f"{checkpoint_dir(self.spark).rstrip('/')}/kpiloom-page-{uuid.uuid4().hex}"
        self.scratch.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        jvm = self.spark._jvm
        for path in self.scratch:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        self.scratch = []
        self._makers, self._made = {}, {}

    def __enter__(self) -> Page:
        return self

    def __exit__(self, *error) -> None:
        self.close()


def _in_any(*periods: Period):
    """Rows of any of the periods: distant periods don't draw in what lies between."""
    cond = ads.in_period(periods[0])
    for p in periods[1:]:
        cond = cond | ads.in_period(p)
    return cond


def ads_page(tables: Tables, period: Period, config: ReportConfig, today: date) -> Page:
    """All ads-page reports (R2-R9 and U5) from one scan of the campaign facts, one aggregate of
    the history and one of the product facts."""
    page = Page(tables.campaign_stats.sparkSession)
    cid, history = config.customer_id, tables.campaign_history
    spans = _in_any(period, trailing_year(today))
    shared = page.shared(lambda: daily_rollup(tables.campaign_stats.where(ads.is_account(tables.campaign_stats, cid) & spans)))
    versions = page.shared(lambda: name_versions(history_of(history, shared().select("id").distinct())))
    latest = page.shared(lambda: latest_of(versions()))
    products = page.shared(lambda: ads.product_performance(tables.products, period, cid, ordered=False))

    def by_version(ordered: bool) -> DataFrame:
        names = versions().select("id", "name", "n_versions")
        return ads.conversions_by_campaign_version(shared(), history, period, cid, versions=names, ordered=ordered)

    page.report("segment_totals", lambda: segment_totals(shared(), history, period, config, today=today, latest=latest()))
    page.report("account_daily", lambda: ads.account_daily(shared(), period, cid))
    page.report("conversions_by_campaign_version", lambda: by_version(True))
    page.report("campaign_performance", lambda: ads.campaign_performance(shared(), history, period, cid, latest=latest()))
    page.report("product_performance", lambda: ads.by_cost(products()))
    page.report("cards", lambda: present.ads_cards(page["segment_totals"]))
    page.report("campaign_table", lambda: present.report_table(page["campaign_performance"]))
    page.report("product_table", lambda: present.report_table(page["product_performance"]))
    page.report("series", lambda: present.ads_series(ads.account_daily(shared(), period, cid, ordered=False), by_version(False)))
    return page


def seo_page(tables: Tables, period: Period, config: ReportConfig, today: date) -> Page:
    """All SEO-page reports (R10-R12) from one scan of the event report.

    The event report is summed once to (date, channel) over the period, its previous period
    and the trailing twelve months.
    """
    page = Page(tables.channel_event_report.sparkSession)
    channels = list(config.channels)
    periods = _in_any(period, previous_period(period).previous, last_12_months(today))
    events = tables.channel_event_report.where(periods & F.col(organic.EVENT_CHANNEL).isin(channels))
    shared = page.shared(
        lambda: events.groupBy("date", organic.EVENT_CHANNEL).agg(*[
            F.sum(m).alias(m) for m in ("sessions", "new_users", "event_count", "total_revenue")
        ])
    )
    page.report("organic_summary", lambda: organic.organic_summary(tables.channel_session_report, shared(), period, channels))
    page.report("organic_daily_compare", lambda: organic.organic_daily_compare(shared(), period, channels))
    page.report("organic_monthly", lambda: organic.organic_monthly(shared(), today, channels))
    page.report("cards", lambda: present.seo_cards(page["organic_summary"]))
    page.report("series", lambda: present.seo_series(
        organic.organic_daily_compare(shared(), period, channels, ordered=False),
        organic.organic_monthly(shared(), today, channels, ordered=False),
    ))
    return page


def overview_page(tables: Tables, period: Period, config: ReportConfig) -> Page:
    page = Page(tables.campaign_stats.sparkSession)
    page.report("marketing_overview", lambda: overview.marketing_overview(tables, period, config))
    page.report("cards", lambda: present.overview_cards(page["marketing_overview"]))
    return page
