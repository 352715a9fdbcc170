"""Storage layout for co-located campaign joins: facts and history bucketed by ``id``.

Every campaign report sums the stats per ``id`` and joins the campaign dimension on
``id``. When the daily rollup and the latest-version dimension
(``latest_campaign(history)``, passed to the reports as ``latest=``) are saved as
tables bucketed by ``id`` into the same number of buckets, Spark reads them already
hash-partitioned: the per-id aggregate and the join run without any exchange on
``id``. Only the small per-name and global aggregates after the join still shuffle.
Both tables hold at most one row per id (and account-day), so a hot id cannot
swell one bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

BUCKET_KEY = "id"


def save_bucketed(
    df: DataFrame,
    table: str,
    buckets: int,
    path: str | None = None,
    partition_by: str | None = None,
) -> None:
    """Save ``df`` as a catalog table bucketed and sorted by ``id``.

    The rows are first hash-partitioned into ``buckets`` tasks on ``id`` (the same hash
    as the buckets), so each task writes one file per bucket and partition value, not
    one per task. Bucket aggregated tables (the daily rollup, the latest dimension)
    rather than raw facts or all versions: a hot id then adds at most one row per
    (account, day), so no bucket grows with it.
    ``path`` makes it an external table at that location (shared storage on a
    cluster). ``partition_by`` should be coarse (a month, not a day), because files
    number buckets x partition values. Use the same ``buckets`` for facts and history.
    """
    writer = (
        df.repartition(buckets, BUCKET_KEY)
        .write.mode("overwrite")
        .bucketBy(buckets, BUCKET_KEY)
        .sortBy(BUCKET_KEY)
    )
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
