"""Report sinks: results are written by Spark, never collected to be saved.

A page is written as a whole: all its reports go to a new folder, and one small manifest then
names that folder as the current version. Readers follow the manifest, so they see all reports of
one version or all of another; a report that fails, or a driver that is lost, leaves the former
page as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from kpiloom.sources.files import read_json, remove, replace_json

MANIFEST = "_manifest.json"


def write_report(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Write one report (Parquet by default; ``fmt='json'`` / ``'csv'`` for exports)."""
    df.write.mode(mode).format(fmt).save(path)


def write_reports(reports: Mapping[str, DataFrame], root: str, mode: str = "overwrite") -> None:
    """Write reports under ``root/<report name>``, one after the other."""
    base = root.rstrip("/")
    for name, df in reports.items():
        write_report(df, f"{base}/{name}", mode=mode)


def page_manifest(spark: SparkSession, root: str) -> dict | None:
    """The manifest at ``root``: version, reports, time, and the versions before. None: no page."""
    return read_json(spark, f"{root.rstrip('/')}/{MANIFEST}")


def write_page(spark: SparkSession, reports: Mapping[str, DataFrame], root: str, keep: int = 1, fmt: str = "parquet") -> str:
    """Write all ``reports`` as a new version of the page at ``root`` and make it the current one;
    returns the version.

    If a report fails, what was written of the new version is removed and the error raised. The
    ``keep`` versions before stay for readers that still follow the older manifest. One writer a
    page at a time: of two, the later manifest wins.
    """
    base = root.rstrip("/")
    now = datetime.now(timezone.utc)
    version = f"{now:%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    folder = f"{base}/versions/{version}"
    names = []
    try:
        for name in reports:  # a page builds its reports one by one
            write_report(reports[name], f"{folder}/{name}", mode="errorifexists", fmt=fmt)
            names.append(name)
        former = page_manifest(spark, base)
        before = [former["version"], *former["before"]] if former else []
        replace_json(spark, base, MANIFEST, {"version": version, "reports": names, "format": fmt, "written": now.isoformat(), "before": before[:keep]})
    except BaseException:
        remove(spark, folder)
        raise
    for old in before[keep:]:
        remove(spark, f"{base}/versions/{old}")
    return version


def read_page(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The reports of the page's current version, all of one version."""
    base, manifest = root.rstrip("/"), page_manifest(spark, root)
    if manifest is None:
        raise FileNotFoundError(f"no page at {root}")
    folder = f"{base}/versions/{manifest['version']}"
    return {name: spark.read.format(manifest["format"]).load(f"{folder}/{name}") for name in manifest["reports"]}
