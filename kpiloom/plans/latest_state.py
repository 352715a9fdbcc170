"""The latest version of every campaign, kept up to date (W1 maintained).

``latest_campaign`` reads the whole history for every report. Here the newest version per id is a
stored state that arriving versions are merged into. "Newest" is the greatest under one total
order (``dims.version_order``), so merging is commutative, associative and idempotent: versions
may arrive in any order, twice, or in any split, and a replayed batch changes nothing.

The state is stored in hash buckets of the id. A merge reads and rewrites only the buckets that
arrivals fall into; each rewritten bucket goes to a new folder, and one small document then names
the current folder of every bucket, so readers and a failing merge never see a mixture. Choose the
number of buckets so that one holds some 100 MB of ids; it is fixed when the state is created.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kpiloom.operators.dims import version_order
from kpiloom.sources.files import read_json, remove, replace_json
from kpiloom.sources.tables import CAMPAIGN_HISTORY, conform

STATE = "_buckets.json"
_BUCKET = "bucket"


def newest(versions: DataFrame) -> DataFrame:
    """The newest whole version row per id, NULL id included. An id's versions leave each map task
    as one row (partial ``WindowGroupLimit``)."""
    w = Window.partitionBy("id").orderBy(*version_order(versions))
    return versions.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, root: str, folders: dict[str, str], schema) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{folder}/{_BUCKET}={b}" for b, folder in sorted(folders.items())])


def merge_latest(spark: SparkSession, root: str, arrivals: DataFrame, buckets: int = 64, keep: int = 1) -> list[int]:
    """Merge arriving versions (``campaign_history`` rows) into the state at ``root``; returns the
    buckets that were rewritten. ``buckets`` counts for a new state only. Folders that ``keep``
    later merges have replaced are removed. One writer at a time."""
    base = root.rstrip("/")
    state = read_json(spark, f"{base}/{STATE}") or {"buckets": buckets, "folders": {}, "replaced": []}
    n, folders = state["buckets"], state["folders"]
    new = newest(conform(arrivals, "campaign_history")).withColumn(_BUCKET, _bucket(n))
    # Arrivals are written once: their buckets are listed and then merged without a second reading.
    staged, folder = f"{base}/arrivals-{uuid.uuid4().hex}", f"merge-{uuid.uuid4().hex}"
    try:
        new.write.partitionBy(_BUCKET).parquet(staged)
        schema = CAMPAIGN_HISTORY
        arrived = spark.read.schema(new.schema).option("basePath", staged).parquet(staged)
        touched = sorted(r[0] for r in arrived.select(_BUCKET).distinct().collect())  # at most n numbers
        if not touched:
            return []
        current = _read(spark, base, {str(b): folders[str(b)] for b in touched if str(b) in folders}, schema)
        both = current.unionByName(arrived.select(*schema.names))
        # The window's exchange is by id; rows of a bucket are gathered for one file a bucket and task.
        merged = newest(both).withColumn(_BUCKET, _bucket(n))
        merged.write.partitionBy(_BUCKET).parquet(f"{base}/{folder}")
    except BaseException:
        remove(spark, f"{base}/{folder}")
        raise
    finally:
        remove(spark, staged)
    gone = [f"{folders[str(b)]}/{_BUCKET}={b}" for b in touched if str(b) in folders]
    replaced = [gone, *state["replaced"]]
    replace_json(spark, base, STATE, {
        "buckets": n, "folders": folders | {str(b): folder for b in touched}, "replaced": replaced[:keep],
    })
    for old in replaced[keep:]:
        for path in old:
            remove(spark, f"{base}/{path}")
    return touched


def read_versions(spark: SparkSession, root: str) -> DataFrame:
    """The newest version row of every id (``campaign_history`` columns)."""
    base = root.rstrip("/")
    state = read_json(spark, f"{base}/{STATE}")
    return _read(spark, base, state["folders"] if state else {}, CAMPAIGN_HISTORY)


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    """``id, name``: what ``latest_campaign`` gives for all versions merged so far. Pass it to the
    reports as ``latest=``."""
    return read_versions(spark, root).select("id", "name")


def start_latest_stream(spark: SparkSession, source_path: str, root: str, checkpoint_location: str, buckets: int = 64) -> StreamingQuery:
    """Merge the version files that arrive at ``source_path`` and stop when all that are there are
    merged. A replayed micro-batch merges the same versions again, which changes nothing."""
    arrivals = spark.readStream.schema(CAMPAIGN_HISTORY).parquet(source_path)
    writer = arrivals.writeStream.foreachBatch(lambda batch, _: merge_latest(spark, root, batch, buckets) and None)
    return writer.option("checkpointLocation", checkpoint_location).trigger(availableNow=True).start()
