"""Distributed 1-based positions of a sorted DataFrame, as one lazy plan.

``row_number()`` over a window without ``partitionBy`` moves every row into one task. Here the
rows are dealt to ordered buckets, numbered inside their bucket, and shifted by the number of
rows in the buckets before:

* **Bounds.** The bounds between buckets are quantiles of the *full* order key, taken from at
  most ``SAMPLED`` keys a bucket: rows are hashed into that many cells and each cell gives one.
  A hash of the whole row is the key's last part, so rows tied on everything else still spread
  over buckets, and the order is the same in every run.
* **Offsets.** One count per bucket.

Bounds and offsets are scalar subqueries of the plan: arrays whose size is bounded by the number
of buckets, whatever the data. Building the result runs no job and writes nothing; when it runs,
the subqueries read the same shuffled report as the main branch (Spark reuses the exchange,
because every branch reads all columns).
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLED = 16
MOST_BUCKETS = 1024
_PID, _KEY, _BOUNDS, _OFFSETS = "_pos_pid", "_pos_key", "_pos_bounds", "_pos_offsets"


@dataclass(frozen=True)
class By:
    """One part of a sort order; NULLs go last unless said otherwise, in either direction."""

    column: Column
    ascending: bool = True
    nulls_last: bool = True

    def sort(self) -> Column:
        c = self.column
        if self.ascending:
            return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()
        return c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()


def _keys(order: list[By | Column]) -> list[By]:
    return [o if isinstance(o, By) else By(o) for o in order]


def _key(order: list[By]) -> Column:
    """The order key of a row: per part whether it goes last for being NULL, and its value."""
    parts = []
    for i, o in enumerate(order):
        parts += [(o.column.isNull() == F.lit(o.nulls_last)).alias(f"n{i}"), o.column.alias(f"v{i}")]
    return F.struct(*parts)


def _before(order: list[By], a: str, b: str) -> str:
    """SQL: key ``a`` comes strictly before key ``b``."""
    out = "false"
    for i, o in reversed(list(enumerate(order))):
        less = f"coalesce({a}.v{i} {'<' if o.ascending else '>'} {b}.v{i}, false)"
        out = f"({a}.n{i} < {b}.n{i} OR ({a}.n{i} = {b}.n{i} AND ({less} OR ({a}.v{i} <=> {b}.v{i} AND {out}))))"
    return out


def _bounds(keyed: DataFrame, order: list[By], buckets: int) -> Column:
    """Scalar subquery: the sorted bounds, and every ``isqrt(buckets)``-th of them."""
    # The row's hash is a part of the key, so the draw hashes it again: a draw of small hashes would
    # cut rows that differ in nothing else at one end.
    draw = lambda seed: f"xxhash64({_KEY}.v{len(order) - 1}, {seed})"
    drawn = keyed.groupBy(F.expr(f"pmod({draw(1)}, {SAMPLED * buckets}) AS cell")).agg(F.expr(f"min_by({_KEY}, {draw(2)}) AS k"))
    compare = f"(a, b) -> CASE WHEN {_before(order, 'a', 'b')} THEN -1 WHEN {_before(order, 'b', 'a')} THEN 1 ELSE 0 END"
    # The j-th of buckets - 1 quantiles; few sampled keys give equal bounds, none gives none.
    fine = f"transform(sequence(1, {buckets - 1}), j -> get(s, CAST(floor(j * size(s) / {buckets}) AS INT)))"
    return (
        drawn.agg(F.expr(f"array_sort(collect_list(k), {compare}) AS s")).where("size(s) > 0").selectExpr(f"{fine} AS f")
        .selectExpr(f"struct(filter(f, (b, i) -> (i + 1) % {isqrt(buckets)} = 0) AS coarse, f AS fine)").scalar()
    )


def _bucketed(keyed: DataFrame, order: list[By], buckets: int) -> DataFrame:
    """``keyed`` plus the number of bounds before the row, found in two steps of sqrt(buckets)."""
    if buckets == 1:
        return keyed.withColumn(_PID, F.lit(0))
    step, before = isqrt(buckets), f"b -> {_before(order, 'b', _KEY)}"
    whole = f"size(filter({_BOUNDS}.coarse, {before})) * {step}"
    rest = f"size(filter(slice({_BOUNDS}.fine, {_PID} + 1, {step}), {before}))"
    coarse = keyed.withColumn(_BOUNDS, _bounds(keyed, order, buckets)).withColumn(_PID, F.expr(whole))
    return coarse.withColumn(_PID, F.expr(f"coalesce({_PID} + {rest}, 0)")).drop(_BOUNDS)


def with_position(
    df: DataFrame,
    order: list[By | Column],
    name: str = "position",
    partition_by: list[str] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """``df`` sorted by ``order`` plus a BIGINT 1-based ``name`` column.

    ``order`` holds ``By`` parts; a plain column is ascending with NULLs last. Rows tied on all of
    them are numbered in the order of a hash of the whole row. With ``partition_by`` the
    numbering restarts in every group: buckets are cut by (group, order), and the rows that a
    group has in earlier buckets are counted by an ordinary grouped aggregate and join.
    ``buckets`` defaults to the session's shuffle partitions; it bounds tasks and arrays, not
    rows. ``df`` must be deterministic, as every lazily repeated plan must.
    """
    groups = list(partition_by or [])
    if buckets is None:
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(buckets, MOST_BUCKETS))
    full = [*_keys([F.col(g) for g in groups]), *_keys(order), By(F.xxhash64(*df.columns))]
    dealt = _bucketed(df.withColumn(_KEY, _key(full)), full, buckets)

    # One bucket a task, in order, so the rows come back sorted.
    placed = dealt.repartitionById(buckets, _PID)
    window = Window.partitionBy(_PID, *groups).orderBy(*[o.sort() for o in full])
    numbered = placed.withColumn(name, F.row_number().over(window).cast("bigint"))
    if not groups:
        before = "aggregate(filter(c, x -> x.b < i), 0L, (total, x) -> total + x.n)"
        offsets = (
            dealt.groupBy(_PID).agg(F.expr("count(1) AS n")).agg(F.expr(f"collect_list(struct({_PID} AS b, n AS n)) AS c"))
            .selectExpr(f"transform(sequence(0, {buckets - 1}), i -> {before})").scalar()
        )
        return numbered.withColumn(_OFFSETS, offsets).select(
            *[F.col(c) for c in df.columns], F.expr(f"get({_OFFSETS}, {_PID}) + `{name}`").alias(name)
        )
    held = dealt.groupBy(*groups, _PID).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy(_PID)
    marks = [f"_grp{i}" for i in range(len(groups))]
    offsets = held.withColumn("_offset", F.sum("_n").over(earlier) - F.col("_n")).select(
        *[F.col(g).alias(m) for g, m in zip(groups, marks, strict=True)], F.col(_PID).alias("_grp_pid"), "_offset"
    )
    same = F.col(_PID) == F.col("_grp_pid")
    for g, m in zip(groups, marks, strict=True):
        same &= F.col(g).eqNullSafe(F.col(m))
    return numbered.join(offsets, same).select(*[F.col(c) for c in df.columns], (F.col("_offset") + F.col(name)).alias(name))
