"""Helpers shared by the operators: intermediate tables, row keys, word expressions, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.session import checkpoint_dir

#: Separators of the two word definitions, as Java regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
NON_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Folders given out by ``scratch_path`` in this process, in order.
SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str, made: list[str] | None = None) -> str:
    """A new folder name below the cluster's checkpoint folder, removed when the driver ends;
    also added to ``made``, by which a caller removes its own folders sooner."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    SCRATCH.append(path)
    if made is not None:
        made.append(path)
    return path


def remove_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of ``scratch_path`` that nothing needs any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        if path in SCRATCH:
            SCRATCH.remove(path)


def materialise(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the checkpoint folder and read it back: the lineage is cut,
    the rows are fixed, and a lost executor costs a reread instead of a recomputation."""
    path = scratch_path(df.sparkSession, name, made)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two 64-bit hashes that name a row by its id and text, nulls included. Equal rows share
    a key on purpose: their results are equal too."""
    return [
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("rk1"),
        F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col)).alias("rk2"),
    ]


def space_words(text: str = "text") -> Column:
    """Words between ASCII white space; none for NULL."""
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE, -1), "")


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(column, UPPER, LOWER)


def rolling(hashes: str, k: int) -> str:
    """SQL for the array of hashes of ``k`` consecutive elements of the BIGINT array
    ``hashes``. Entry i covers elements i..i+k-1; the last k-1 entries are incomplete and must
    be cut by the caller. Built by doubling, so a k-gram costs about log2(k) hashes."""
    if k == 1:
        return hashes
    half = 1 << ((k - 1).bit_length() - 1)
    left, right = rolling(hashes, half), rolling(hashes, k - half)
    return (
        f"transform(array({left}), _l{k} -> zip_with(_l{k}, "
        f"slice({right if k - half != half else f'_l{k}'}, {half + 1}, greatest(size(_l{k}), 1)), "
        f"(a, b) -> xxhash64(a, b)))[0]"
    )


def components(links: DataFrame, name: str, most: int = 60, made: list[str] | None = None) -> DataFrame:
    """Connected components of ``links`` (a, b: BIGINT): one row (node, root) per linked node
    other than the root, the smallest node of the component.

    Alternating large-star and small-star steps; each is an aggregate and a join on edges,
    minima are combined before the shuffle, and each round is written to the checkpoint folder.
    """

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    edges = materialise(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        name,
        made,
    )
    before = state(edges)
    for _ in range(most):
        if not before[0]:
            break
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                    F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                )
            ).alias("e")
        ).select("e.*").where("a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ).distinct()
        edges = materialise(small, name, made)
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
