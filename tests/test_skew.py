"""A hot key (a third of all rows on one id) is combined map-side: the shuffle carries at
most one row per (map task, key), measured from the executed plan's shuffle metrics."""

from datetime import date

from pyspark.sql import functions as F

from kpiloom import Period
from kpiloom.operators import ads
from kpiloom.operators.dims import latest_campaign

P = Period(date(2024, 3, 1), date(2024, 3, 31))
ROWS, MAPS = 90_000, 6


def _nodes(plan):
    """All physical operators of an executed (adaptive) plan, query stages unwrapped."""
    out, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
            continue
        out.append(node)
        children = node.children()
        todo.extend(children.apply(i) for i in range(children.size()))
    return out


def _records_written(df, key: str) -> list[int]:
    df.collect()  # runs this DataFrame's own query execution (a write would plan anew)
    plan = df._jdf.queryExecution().executedPlan()
    found = []
    for node in _nodes(plan):
        if node.nodeName() == "Exchange" and f"hashpartitioning({key}" in node.toString():
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
    return found


def _hot_stats(spark):
    # id 1 holds a third of the rows; the rest spread over 30 000 ids.
    base = spark.range(ROWS).repartition(MAPS)
    return base.select(
        F.lit("C").alias("customer_id"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 30_000 + 2).cast("long").alias("id"),
        F.lit(date(2024, 3, 10)).alias("date"),
        F.lit(10).cast("long").alias("impressions"),
        F.lit(1).cast("long").alias("clicks"),
        F.lit(1_000_000).cast("long").alias("cost_micros"),
        F.lit(1).cast("decimal(18,2)").alias("conversions"),
        F.lit(2).cast("decimal(18,2)").alias("conversions_value"),
    )


def test_hot_id_is_combined_before_the_shuffle(spark):
    stats = _hot_stats(spark)
    per_id = ads.stats_by_id(stats, P, "C")
    written = _records_written(per_id, "id")
    assert written, "no id exchange found"
    # Without map-side combine the exchange would carry all 90 000 rows. With it, the hot
    # id's 30 000 rows shrink to at most one per map task; the other 60 000 rows (about two
    # per id) cannot shrink much.
    assert max(written) <= (ROWS - ROWS // 3) + MAPS
    (hot,) = per_id.where("id = 1").collect()
    assert hot.sum_clicks == ROWS // 3


def test_hot_id_versions_are_limited_before_the_shuffle(spark):
    # One id with a third of all versions: the partial row_number limit keeps one row
    # per (map task, id) in front of the exchange.
    hist = spark.range(ROWS).repartition(MAPS).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 30_000 + 2).cast("long").alias("id"),
        F.concat(F.lit("v"), F.col("id").cast("string")).alias("name"),
        F.date_add(F.lit(date(2020, 1, 1)), (F.col("id") % 1000).cast("int")).alias("start_date"),
        F.col("id").alias("version_id"),
    )
    latest = latest_campaign(hist)
    written = _records_written(latest, "id")
    assert written and max(written) <= (ROWS - ROWS // 3) + MAPS
    (hot,) = latest.where("id = 1").collect()
    assert hot.name.startswith("v")


def test_history_rows_that_reach_the_shuffle_are_bounded_by_the_period(spark):
    """20 000 campaigns with versions, 30 of them in the period: nothing else is shuffled but the
    few that pass the bitmap by chance."""
    from kpiloom.functions.reduction import BITS

    stats = spark.range(3_000).select(
        F.lit("C").alias("customer_id"), (F.col("id") % 30 * 600).alias("id"), F.lit(date(2024, 3, 10)).alias("date"),
        *[F.lit(1).cast("long").alias(c) for c in ("impressions", "clicks", "cost_micros")],
        *[F.lit(1).cast("decimal(18,2)").alias(c) for c in ("conversions", "conversions_value")],
    )
    history = spark.range(60_000).repartition(MAPS).select(
        (F.col("id") % 20_000).alias("id"), F.concat(F.lit("n"), F.col("id") % 7).alias("name"),
        F.lit(date(2024, 1, 1)).alias("start_date"), F.col("id").alias("version_id"),
    )
    for report in (ads.campaign_performance, ads.conversions_by_campaign_version):
        df = report(stats, history, P, "C")
        keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            found = [n for n in _records_written(df, "id") if n]
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
        by_chance = 60_000 * 30 / BITS * 3 + 50
        assert found and max(found) <= 30 * 3 * MAPS + by_chance, report.__name__
        assert df.count() == 7
