"""Embedding whitening against NumPy on the same rows, and odd rows."""

import duckdb
import numpy as np
import pytest

from kpiloom.llm import queries, whitening

SF001 = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


def expected(xs):
    fit = np.array(sorted({tuple(x) for x in xs}), dtype=object)
    n, total = len(fit), fit.sum(0)
    centred = (fit * n - total).astype(float) / n
    v = centred.T @ centred / n
    e, axes = np.linalg.eigh(v)
    return n, total, v, e[::-1], axes[:, ::-1]


def test_query_against_numpy(spark):
    raw = dict(duckdb.sql(f"select vec_id, embedding from '{SF001}/embeddings.parquet'").fetchall())
    xs = {i: [int(np.floor(64 * c)) + 1_000_000 for c in e] for i, e in raw.items()}
    n, total, v, e, axes = expected(xs.values())
    got = queries.op12_embedding_whitening(spark, SF001).collect()
    assert len(got) == 16 * len(xs) and {r.n for r in got} == {n}
    sign = {}
    for r in got:
        x, k = xs[r.vec_id], r.component - 1
        assert r.deviation == sum((n * c - s) ** 2 for c, s in zip(x, total))
        want = ((np.array(x) * n - total).astype(float) / n) @ axes[:, k] / np.sqrt(e[k])
        sign.setdefault(k, np.sign(r.whitened * want) or 1.0)
        assert r.whitened == pytest.approx(sign[k] * want, abs=1e-8)
        assert r.explained == pytest.approx(e[k] / np.trace(v), rel=1e-9) and r.identity_error < 1e-9


def test_bit_planes_count_exactly(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(a) for a in r], 0) for i, r in enumerate(rng.integers(-40_000, 90_000, (700, 5)) / 64)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(3000)]  # one very common vector
    table = vectors(spark, rows).repartition(7)
    whole = whitening.whole_rows(table)
    fit = whole.select("_x").distinct()
    low, high, sums = map(list, zip(*whitening.ranges(fit)))
    x = np.array(sorted({tuple(int(np.floor(64 * c)) + 1_000_000 for c in r[1]) for r in rows}))
    assert low == x.min(0).tolist() and high == x.max(0).tolist() and sums == x.sum(0).tolist()
    y = x - x.min(0)
    got = whitening.scatter(fit, low, [(b - a).bit_length() for a, b in zip(low, high)])
    assert {k: v for k, v in got.items() if v} == {(i, j): int(y[:, i] @ y[:, j]) for i in range(5) for j in range(i, 5)}
    out = whitening.whiten(table).collect()
    assert len(out) == 3700 and {r.n for r in out} == {700} and len(out[0].whitened) == 5
    z = np.array([r.whitened for r in {r.vec_id: r for r in out if r.vec_id < 700}.values()])
    assert np.abs(np.cov(z.T, bias=True) - np.eye(5)).max() < 1e-9


def test_odd_rows(spark):
    rows = [
        (1, [0.5, 1.0], 7), (2, None, 0), (3, [1.0, None], 0), (4, [NAN, 1.0], 0), (5, [1.0, -INF], 0), (None, [2.0, -1.0], 0),
        (1, [0.5, 1.0], 7), (6, [], 0), (7, [1.0, 2.0, 3.0], 0), (8, [-0.01, 3.0], 0), (9, [-0.005, 3.0], 0),
    ]
    table = vectors(spark, rows).selectExpr("*", "'mine' AS n", "label AS whitened")
    out = whitening.whiten(table).collect()
    assert sorted((r.vec_id or 0) for r in out) == [0, 1, 1, 8, 9]
    assert {r.n for r in out} == {3}  # 8 and 9 fall to one integer vector
    assert out[0].embedding is not None and all(len(r.whitened) == 2 for r in out)
    z = {r.vec_id: tuple(r.whitened) for r in out}
    assert z[8] == z[9] != z[1]


def test_no_variance_and_empty(spark):
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect() == []
    assert whitening.whiten(vectors(spark, [])).collect() == []
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 4.0], 0) for i in range(5)])).collect()
    assert {len(r.whitened) for r in flat} == {1} and flat[0].explained == [1.0]


def test_wide_range_stays_exact(spark):
    rows = [(i, [2.0**40 * (i % 3), float(i)], 0) for i in range(6)] + [(9, [-(2.0**40), 1.5], 0)]
    out = whitening.whiten(vectors(spark, rows)).collect()
    xs = [[int(64 * c) + 1_000_000 for c in r[1]] for r in rows]
    total = [sum(c) for c in zip(*xs)]
    want = {r[0]: sum((7 * c - s) ** 2 for c, s in zip(x, total)) for r, x in zip(rows, xs)}
    assert {r.vec_id: r.deviation for r in out} == {k: v if v < 2**63 else None for k, v in want.items()}
    assert out[0].identity_error < 1e-6
