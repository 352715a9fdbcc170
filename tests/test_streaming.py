"""Streaming rollup maintenance: equal to the batch rollup, and a replayed epoch does not
double count."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from kpiloom.operators import ads
from kpiloom.plans.rollup import daily_rollup, read_rollup, write_rollup
from kpiloom.registry import ADS_PERIOD
from kpiloom.sources.bindings import bind_tables
from kpiloom.streaming.rollup_stream import (
    batch_writer,
    compact,
    read_stream_rollup,
    start_rollup_stream,
)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stream_rollup_matches_batch(spark):
    stats = bind_tables(spark, SF001).campaign_stats
    root = tempfile.mkdtemp(prefix="kpiloom-stream-")
    src, out, ckpt = (os.path.join(root, d) for d in ("src", "rollup", "ckpt"))
    # Facts arrive as two files: before and from 1998.
    stats.where(F.col("date") < "1998-01-01").write.parquet(os.path.join(src, "part-a"))
    q = start_rollup_stream(spark, os.path.join(src, "*"), out, ckpt)
    q.awaitTermination(300)
    stats.where(F.col("date") >= "1998-01-01").write.parquet(os.path.join(src, "part-b"))
    q = start_rollup_stream(spark, os.path.join(src, "*"), out, ckpt)
    q.awaitTermination(300)

    want = rows(daily_rollup(stats))
    assert rows(read_stream_rollup(spark, out)) == want

    # Replaying the last epoch rewrites its own folder: no double counting.
    last = max(int(d.split("=")[1]) for d in os.listdir(out) if d.startswith("batch_id="))
    batch_writer(out)(stats.where(F.col("date") >= "1998-01-01"), last)
    assert rows(read_stream_rollup(spark, out)) == want

    assert compact(spark, out) == 0 and sorted(os.listdir(out)) == ["batch_id=1", "compacted_to=0"]
    assert rows(read_stream_rollup(spark, out)) == want
    # Newer epochs are added to what is compacted; replaying the kept one still replaces it.
    batch_writer(out)(stats.where(F.col("date") >= "1998-01-01"), last)
    assert rows(read_stream_rollup(spark, out)) == want
    assert compact(spark, out, keep=0) == 1 and compact(spark, out, keep=0) == -1
    rolled = read_stream_rollup(spark, out)
    assert rows(rolled) == want
    assert rows(ads.account_totals(rolled, ADS_PERIOD, "O")) == rows(
        ads.account_totals(stats, ADS_PERIOD, "O"))


def test_double_measures_stream_through(spark, tmp_path):
    stats = bind_tables(spark, SF001).campaign_stats.withColumn("conversions", F.col("conversions").cast("double"))
    stats.write.parquet(f"{tmp_path}/src/a")
    q = start_rollup_stream(spark, f"{tmp_path}/src/*", f"{tmp_path}/out", f"{tmp_path}/ckpt")
    q.awaitTermination(300)
    got = read_stream_rollup(spark, f"{tmp_path}/out")
    assert dict(got.dtypes)["conversions"] == "double"
    want = daily_rollup(stats).agg(F.round(F.sum("conversions"), 6)).first()[0]
    assert got.agg(F.round(F.sum("conversions"), 6)).first()[0] == want


def test_rebuilding_a_day_keeps_the_others(spark, tmp_path):
    stats = bind_tables(spark, SF001).campaign_stats
    path = f"{tmp_path}/rollup"
    write_rollup(daily_rollup(stats), path)
    before = rows(read_rollup(spark, path))
    day = daily_rollup(stats).agg(F.min("date")).first()[0]
    write_rollup(daily_rollup(stats.where(F.col("date") == F.lit(day))), path)
    assert rows(read_rollup(spark, path)) == before
