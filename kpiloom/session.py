"""Spark session and checkpoint-directory helpers for local runs (tests, bench)."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "kpiloom"):
    """A local session tuned for small data: AQE on, UI off, UTC, few shuffle partitions."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only when none is configured and the master is local (tests) is a fresh local
    folder set; on a cluster a missing setting is an error, so ``checkpoint()`` and
    written intermediate tables always land in the folder the cluster names.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # no driver-side context (remote session): the server's setting applies
        target = spark.conf.get("spark.checkpoint.dir", None)
        if not target:
            raise RuntimeError("set spark.checkpoint.dir on the server to a folder on shared storage") from None
        return target
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder on shared storage; "
            "a machine-local fallback is only used in local mode"
        )
    target = configured or fallback or tempfile.mkdtemp(prefix="kpiloom-ckpt-")
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir() or target
