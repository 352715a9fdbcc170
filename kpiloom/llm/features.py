"""Training helpers of the two classifiers: labelled rows and the split by crc32 of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; NULL for a NULL id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def labelled(docs: DataFrame, labels: DataFrame, target: str, modulus: int, held_out: int, most: int, id_col: str = "doc_id") -> DataFrame:
    """(id_col, text, y) of training rows: labelled 0 or 1, not held out, one label an id (the
    largest if there are several). Beyond ``most`` labelled ids, those with the smallest hash
    are taken, so the sample is fixed and bounded."""
    y = F.col(target).cast("int")
    chosen = (
        labels.where(y.isin(0, 1) & (remainder(modulus, id_col) != held_out)).groupBy(id_col).agg(F.max(y).alias("y"))
        .orderBy(F.xxhash64(id_col), id_col).limit(most)
    )
    return docs.select(id_col, "text").join(F.broadcast(chosen) if most <= 200_000 else chosen, id_col)
