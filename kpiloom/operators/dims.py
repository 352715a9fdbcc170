"""Campaign dimension: the latest version of every campaign."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.functions.reduction import keep_among


def version_order(history: DataFrame) -> list:
    """Newest first: a NULL ``start_date`` ranks first (PostgreSQL ``DESC`` puts NULLs
    first), then the later ``start_date``, then the larger ``version_id`` (or, without
    one, the smaller name) so equal start dates resolve deterministically."""
    order = [F.col("start_date").desc_nulls_first()]
    if "version_id" in history.columns:
        order.append(F.col("version_id").desc_nulls_last())
    order.append(F.col("name").asc_nulls_last())
    return order


def history_of(history: DataFrame, ids: DataFrame | None) -> DataFrame:
    """The history of ``ids`` (of any columns, with ``id``): a report over one month of one
    account needs few of all campaigns ever run. Other ids are dropped in the scan's stage; the
    few that pass by chance fall to the report's own join with the ids. None keeps all."""
    return history if ids is None else keep_among(history, ids, "id")


def latest_campaign(history: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``id, name``: one row per campaign id, its newest version. With ``ids``, for those at
    least (``history_of``).

    ``row_number() = 1`` per id is planned as a partial ``WindowGroupLimit`` before
    the shuffle, so even an id holding a large share of all versions leaves each map
    task as a single row; the output stays hash-partitioned by ``id`` for the joins.
    """
    history = history_of(history, ids)
    w = Window.partitionBy("id").orderBy(*version_order(history))
    return (
        history.withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") == 1)
        .select("id", "name")
    )


def campaign_ids(history: DataFrame) -> DataFrame:
    """Distinct ids with at least one version (partial distinct before the shuffle)."""
    return history.select("id").distinct()


def version_names(history: DataFrame) -> DataFrame:
    """``id, name, n_versions``: how many versions of each id carry each name."""
    return history.groupBy("id", "name").agg(F.count(F.lit(1)).alias("n_versions"))


def name_versions(history: DataFrame) -> DataFrame:
    """``id, name, n_versions, newest``: per id and name the number of versions and the order
    key of the newest one. One aggregate of the history (combined before the shuffle) that
    holds both what ``version_names`` and what ``latest_campaign`` need."""
    version = F.col("version_id") if "version_id" in history.columns else F.lit(None).cast("bigint")
    # max() puts NULLs first, so a flag ranks a NULL start_date above every date.
    newest = F.struct(
        F.col("start_date").isNull().alias("undated"), "start_date",
        version.isNotNull().alias("numbered"), version.alias("version_id"),
    )
    return history.groupBy("id", "name").agg(F.count(F.lit(1)).alias("n_versions"), F.max(newest).alias("newest"))


def latest_of(versions: DataFrame) -> DataFrame:
    """``id, name`` of the newest version from ``name_versions``; equal to ``latest_campaign``."""
    w = Window.partitionBy("id").orderBy(F.col("newest").desc(), F.col("name").asc_nulls_last())
    return versions.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("id", "name")
