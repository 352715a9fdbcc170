"""Small files beside written tables: JSON documents that name the current folders, replaced by one
rename. Paths may be on any file system that Spark reads."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from kpiloom.session import checkpoint_dir


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the cluster's checkpoint folder, removed when the driver ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/kpiloom-{name}-{uuid.uuid4().hex}"
    fs, target = _at(spark, path)
    fs.deleteOnExit(target)
    return path


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file, if it is there."""
    fs, target = _at(spark, path)
    fs.delete(target, True)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The document at ``path``; None if there is none."""
    fs, target = _at(spark, path)
    if not fs.exists(target):
        return None
    source = fs.open(target)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    finally:
        source.close()


def replace_json(spark: SparkSession, folder: str, name: str, content: dict) -> None:
    """Write ``folder/name`` beside the former document and rename it over that one, so that a
    reader finds the one or the other, whole."""
    jvm = spark._jvm
    fs, draft = _at(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), options)
