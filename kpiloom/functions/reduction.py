"""Reducing a table to the keys that another one holds, before anything is shuffled.

A join reduces a table only after its rows have been shuffled, unless the other side is small
enough to broadcast. ``keep_among`` filters rows in the scan's own stage instead: the keys set
bits in one bitmap of fixed size, which reaches the tasks as a scalar subquery of the same plan.
Nothing else is broadcast, whatever the number of keys; the more keys, the more other rows pass.
Rows that pass by chance must be removed by a join above, which every caller has anyway.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap (128 KB): with 50 000 keys some 5 % of the other rows pass by chance.
BITS = 1 << 20
_MAP = "_among_bits"


def keep_among(df: DataFrame, keys: DataFrame, key: str = "id", bits: int = BITS) -> DataFrame:
    """Rows of ``df`` whose ``key`` is one of ``keys``, and a few others; of the same key type.

    The bitmap is computed from all columns of ``keys``, so that a caller who joins ``keys`` as
    well has them computed once (Spark reuses the exchange below both uses).
    """
    words = bits // 64
    place = f"pmod(xxhash64(`{key}`), {bits})"
    held = keys.select(
        F.expr(f"CAST({place} DIV 64 AS INT) AS word"), F.expr(f"shiftleft(1L, CAST({place} % 64 AS INT)) AS bit"),
        F.xxhash64(*keys.columns).alias("whole"),
    )
    # One row per word, so that the sorted list is a dense array.
    empty = df.sparkSession.range(0, words, 1, 1).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("bigint").alias("bit"), F.lit(0).cast("bigint").alias("whole"))
    per_word = held.unionAll(empty).groupBy("word").agg(F.expr("bit_or(bit) AS bits"), F.max("whole").alias("whole"))
    dense = per_word.agg(F.expr("transform(sort_array(collect_list(struct(word, bits))), x -> x.bits) AS bits"), F.max("whole").alias("whole"))
    bitmap = dense.select(F.struct("bits", "whole")).scalar()
    # Spark copies a filter on a join key to the other side of the join, here the keys themselves,
    # which would then differ from those below the bitmap and be computed twice. A filter that
    # names a second column is not copied.
    second = next(c for c in df.columns if c != key)
    test = f"(get({_MAP}.bits, CAST({place} DIV 64 AS INT)) & shiftleft(1L, CAST({place} % 64 AS INT))) <> least(0, hash(`{second}`) & 7)"
    return df.withColumn(_MAP, bitmap).where(F.expr(test)).drop(_MAP)
