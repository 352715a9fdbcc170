"""Embedding whitening from an exact, bit-sliced scatter matrix.

Every entry c becomes the integer x = floor(64 c) + 1,000,000. The fit list holds each distinct
x vector once. Per dimension the fit list's smallest x is taken off, and the bits that remain are
*bit planes*: across a batch of rows, plane p of dimension i is one bit string, packed into
64-bit words. The scatter is then exact integer work,

    sum over rows of y_i * y_j  =  sum over p, q of 2**(p+q) * popcount(plane_ip AND plane_jq),

so tasks count bits (never larger than the row count) by (i, j, p+q), Spark adds the counts, and
the weights are applied to Python integers: nothing is rounded and nothing overflows, whatever
the range of the entries. The centred scatter n * sum(y_i y_j) - Sy_i * Sy_j is formed in
integers as well, before one division gives the covariance that ``eigh`` decomposes.

What reaches the driver is bounded by the dimension d, not by the rows: d ranges, at most
d * d / 2 * (2 * planes - 1) counts and a 16 x 16 check. A vector that very many rows share is
one row of the fit list; the distinct is combined before its shuffle.

Rules for odd input: rows whose vector is NULL or holds a NULL, NaN or infinite entry are left
out, and so are empty vectors and vectors whose length is not the table's most frequent one
(ties: the longer). Repeated rows and NULL ids are kept and whitened like any other. Directions
without variance (eigenvalue below 1e-12 of the largest) can't be whitened and give no component,
so one single distinct vector, or an empty table, gives no components. Other columns pass
through; a column that has the name of an added one is replaced. A ``deviation`` beyond the
BIGINT range is NULL.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import materialise

SCALE, SHIFT = 64, 1_000_000
#: Eigenvalues at or below this share of the largest count as zero.
FLAT = 1e-12
_ADDED = ("n", "deviation", "whitened", "explained", "identity_error")


@dataclass(frozen=True)
class Whitener:
    """A fitted transform. ``axes`` has one column per component, already over sqrt(eigenvalue)."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    explained: tuple[float, ...]
    identity_error: float


def quantised(embedding: str = "embedding") -> Column:
    """ARRAY<BIGINT> of floor(64 c) + 1,000,000 per entry."""
    return F.expr(f"transform(`{embedding}`, c -> floor({SCALE}D * CAST(c AS DOUBLE)) + {SHIFT}L)")


def usable(embedding: str = "embedding") -> Column:
    """The vector is there, is not empty, and every entry is a finite number."""
    return F.expr(
        f"coalesce(size(`{embedding}`) > 0 AND forall(`{embedding}`, c -> c IS NOT NULL AND NOT isnan(c) "
        f"AND abs(CAST(c AS DOUBLE)) < CAST('Infinity' AS DOUBLE)), false)"
    )


def whole_rows(table: DataFrame, embedding: str = "embedding", column: str = "_x") -> DataFrame:
    """The rows that take part, with ``column`` the integer vector."""
    rows = table.where(usable(embedding)).withColumn(column, quantised(embedding))
    lengths = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size(column) == (lengths[0].d if lengths else 0))


def _matrix(batch: pa.RecordBatch, at: int = 0) -> np.ndarray:
    column = batch.column(at)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def ranges(fit: DataFrame, column: str = "_x") -> list[tuple[int, int, int]]:
    """(smallest, largest, sum) of every dimension, in order."""
    per_task = "pos int, low long, high long, total decimal(38,0)"

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = total = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                # Sums of halves of 32 bits can't overflow within a batch.
                sums = [(int(a) << 32) + int(b) for a, b in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), strict=True)]
                if low is None:
                    low, high, total = x.min(0), x.max(0), sums
                else:
                    low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
                    total = [a + b for a, b in zip(total, sums, strict=True)]
        if low is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(low)), pa.int32()), pa.array(low), pa.array(high), pa.array(total, pa.decimal128(38, 0))],
                names=["pos", "low", "high", "total"],
            )

    found = fit.select(column).mapInArrow(reduce, per_task).groupBy("pos").agg(F.min("low"), F.max("high"), F.sum("total"))
    return [(r[1], r[2], int(r[3])) for r in sorted(found.collect())]


def bit_planes(y: np.ndarray, widths: list[int]) -> np.ndarray:
    """Rows of 64-bit words: for each dimension its planes, lowest first, packed across rows."""
    words = -(-len(y) // 64)
    out = np.zeros((sum(widths), words * 8), np.uint8)
    at = 0
    for i, width in enumerate(widths):
        column = y[:, i]
        for p in range(width):
            packed = np.packbits((column >> p) & 1 != 0, bitorder="little")
            out[at, : len(packed)] = packed
            at += 1
    return out.view(np.uint64)


def scatter(fit: DataFrame, low: list[int], widths: list[int], column: str = "_x") -> dict[tuple[int, int], int]:
    """Exact sum of y_i * y_j for i <= j, y being x less the dimension's smallest value."""
    weights = max(2 * max(widths) - 1, 1) if widths else 1
    starts = np.cumsum([0, *widths])
    owner = np.repeat(np.arange(len(widths)), widths)
    bit = np.concatenate([np.arange(w) for w in widths]) if widths else np.zeros(0, int)
    base = np.array(low, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(widths)
        counts = np.zeros((d, d * weights), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            planes = bit_planes(_matrix(batch) - base, widths)
            for i in range(d):
                rest = planes[starts[i] :]
                for p in range(widths[i]):
                    ones = np.bitwise_count(planes[starts[i] + p] & rest).sum(1, dtype=np.int64)
                    slot = owner[starts[i] :] * weights + bit[starts[i] :] + p
                    counts[i] += np.bincount(slot, ones, d * weights).astype(np.int64)
        i, slot = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "i": i.astype(np.int32), "j": (slot // weights).astype(np.int32), "w": (slot % weights).astype(np.int32), "ones": counts[i, slot],
        })

    per_pair = fit.select(column).mapInArrow(count, "i int, j int, w int, ones long").groupBy("i", "j", "w").agg(F.sum("ones").alias("ones"))
    out: dict[tuple[int, int], int] = {}
    for r in per_pair.toArrow().to_pylist():
        pair = (r["i"], r["j"])
        out[pair] = out.get(pair, 0) + (r["ones"] << r["w"])
    return out


def covariance(n: int, low: list[int], sums: list[int], products: dict[tuple[int, int], int]) -> np.ndarray:
    """Centred in integers; the one rounding is the division by n * n."""
    d = len(low)
    shifted = [s - n * m for s, m in zip(sums, low, strict=True)]
    v = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            v[i, j] = v[j, i] = (n * products.get((i, j), 0) - shifted[i] * shifted[j]) / (n * n)
    return v


def fit_whitener(fit: DataFrame, components: int = 16, column: str = "_x") -> Whitener | None:
    """The whitener of the distinct vectors ``fit``; None if there is none or no variance."""
    n = fit.count()
    if not n:
        return None
    low, high, sums = map(list, zip(*ranges(fit, column), strict=True))
    widths = [(b - a).bit_length() for a, b in zip(low, high, strict=True)]
    v = covariance(n, low, sums, scatter(fit, low, widths, column))
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    kept = int((e[:components] > FLAT * max(e[0], 0.0)).sum()) if e[0] > 0 else 0
    if not kept:
        return None
    w = Whitener(n, tuple(sums), axes[:, :kept] / np.sqrt(e[:kept]), tuple(float(x) for x in e[:kept] / np.trace(v)), 0.0)
    return Whitener(w.n, w.sums, w.axes, w.explained, _identity_error(fit, w, column))


def _whitened(x: np.ndarray, w: Whitener) -> np.ndarray:
    """(x - S/n) on the axes. The integer part of the mean is taken off before the division."""
    whole = np.array([s // w.n for s in w.sums], np.int64)
    rest = np.array([(s % w.n) / w.n for s in w.sums])
    return ((x - whole) - rest) @ w.axes


def _identity_error(fit: DataFrame, w: Whitener, column: str) -> float:
    """Largest entry of |covariance of the whitened fit list - identity|, from the rows."""
    k = w.axes.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                z = _whitened(_matrix(batch), w)
                first += z.sum(0)
                second += z.T @ z
        both = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(both), dtype=np.int32), "v": both})

    total = fit.select(column).mapInArrow(sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    both = np.array([r.v for r in sorted(total)]) / w.n
    cov = both[k:].reshape(k, k) - np.outer(both[:k], both[:k])
    return float(np.abs(cov - np.eye(k)).max())


def _deviations(x: np.ndarray, w: Whitener) -> list[int | None] | np.ndarray:
    """Per row the exact sum of (n * x - S)**2: in 64-bit integers where that is proven to be
    enough, else in Python's; None beyond a BIGINT."""
    whole = [s // w.n for s in w.sums]
    most = int(np.abs(x - np.array(whole, np.int64)).max(initial=0)) + 1
    if (w.n * most) ** 2 * x.shape[1] < 2**63:
        left = np.array([s - w.n * m for s, m in zip(w.sums, whole, strict=True)], np.int64)
        return ((w.n * (x - np.array(whole, np.int64)) - left) ** 2).sum(1)
    exact = (sum((w.n * c - s) ** 2 for c, s in zip(row, w.sums, strict=True)) for row in x.tolist())
    return [v if v < 2**63 else None for v in exact]


def apply_whitener(rows: DataFrame, w: Whitener | None, column: str = "_x") -> DataFrame:
    """``rows`` with n, deviation, whitened and explained (arrays, component 1 first) and
    identity_error; no rows without a whitener."""
    kept = [c for c in rows.columns if c not in (*_ADDED, column)]
    added = "n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    out = rows.select(F.struct(*kept).alias("_row"), F.col(column).alias("_x"))
    schema = f"_row {out.schema['_row'].dataType.simpleString()}, {added}"
    if w is None:
        out = rows.sparkSession.createDataFrame([], schema)
    else:

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m, k = batch.num_rows, w.axes.shape[1]
                x = _matrix(batch, 1) if m else np.zeros((0, len(w.sums)), np.int64)
                ends = pa.array(np.arange(0, (m + 1) * k, k, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array(np.full(m, w.n, np.int64)), pa.array(_deviations(x, w), pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(_whitened(x, w).ravel())),
                        pa.ListArray.from_arrays(ends, pa.array(np.tile(w.explained, m))),
                        pa.array(np.full(m, w.identity_error)),
                    ],
                    names=["_row", "n", "deviation", "whitened", "explained", "identity_error"],
                )

        out = out.mapInArrow(project, schema)
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], *_ADDED)


def whiten(table: DataFrame, embedding: str = "embedding", components: int = 16) -> DataFrame:
    """Fit on the distinct vectors of ``table`` and whiten each of its usable rows."""
    rows = whole_rows(table, embedding)
    fit = materialise(rows.select("_x").distinct(), "whitening-fit")
    return apply_whitener(rows, fit_whitener(fit, components))
