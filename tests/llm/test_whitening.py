"""Eigenpairs, exact deviations and whitened values against dense numpy."""

from __future__ import annotations

import numpy as np
import pytest

from postwatch.llm import contour, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, v string, i int, n long, whitened string"


def brute(rows):
    """The contract in numpy and Python integers: rows are (vec_id, list)."""
    kept = [(i, v) for i, v in rows
            if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    lengths = [len(v) for _, v in kept]
    if not kept:
        return [], [], np.zeros((0, 0)), np.zeros(0), 0.0
    size = max(set(lengths), key=lambda x: (lengths.count(x), x))
    kept = [(i, v) for i, v in kept if len(v) == size]
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[float(n * c - s) / n for c, s in zip(row, sums, strict=True)] for row in x])
    second = centred.T @ centred / n
    values, vectors = np.linalg.eigh(second)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(32, int((values > 1e-12 * values.sum()).sum()))
    white = centred @ (vectors[:, :count] / np.sqrt(values[:count]))
    return kept, deviation, white, values[:count] / values.sum(), n


def check(rows, made):
    kept, deviation, white, shares, n = brute(rows)
    assert len(made) == white.size
    if not white.size:
        return
    found = {}
    for row in made:
        assert (row.n, row.identity_error <= 1e-4) == (n, True)
        assert row.explained == pytest.approx(shares[row.component - 1], rel=1e-6)
        found.setdefault((row.vec_id is None, row.vec_id or 0), []).append(row)
    want = {}
    for (i, _), d, w in zip(kept, deviation, white, strict=True):
        want.setdefault((i is None, i or 0), []).append((d, w))
    assert found.keys() == want.keys()
    signs = np.zeros(white.shape[1])
    for key, held in want.items():
        for k in range(white.shape[1]):
            got = sorted((x.deviation, abs(x.whitened)) for x in found[key] if x.component == k + 1)
            for (d, w), (deviate, value) in zip(sorted((d, abs(w[k])) for d, w in held), got, strict=True):
                assert deviate == d
                assert value == pytest.approx(w, abs=1e-7)
        if len(held) == 1:  # one sign for all rows
            for x in found[key]:
                w = held[0][1][x.component - 1]
                if abs(w) > 1e-6:
                    sign = np.sign(w) * np.sign(x.whitened)
                    assert signs[x.component - 1] in (0, sign)
                    signs[x.component - 1] = sign


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "v", -1, -1, "w") for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("size, count", [(1, 60), (3, 200), (24, 300), (64, 400), (64, 30), (70, 90)])
def test_largest_eigenpairs(size, count):
    held = np.random.default_rng(size + count).standard_normal((count, size))
    held[:, 0] *= 9
    held -= held.mean(0)
    second = held.T @ held / count
    values, vectors = contour.largest(second, 32)
    want = np.linalg.eigvalsh(second)[::-1]
    want = want[want > 1e-12 * want.sum()][:32]
    assert np.allclose(values, want, rtol=1e-12)
    assert np.abs(second @ vectors - vectors * values).max() <= 1e-12 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() <= 1e-12


def test_equal_eigenvalues_and_no_variance():
    values, vectors = contour.largest(np.eye(40), 12)
    assert np.allclose(values, 1) and np.allclose(vectors.T @ vectors, np.eye(12))
    values, _ = contour.largest(np.diag([3.0] * 20 + [1.0] * 20 + [0.0] * 10), 45)
    assert np.allclose(values, [3.0] * 20 + [1.0] * 20)
    assert contour.largest(np.zeros((4, 4)), 3)[0].size == 0
    assert contour.largest(np.zeros((0, 0)), 3)[0].size == 0


def test_inertia_counts_eigenvalues():
    held = np.random.default_rng(5).standard_normal((30, 30))
    held = held + held.T
    values = np.linalg.eigvalsh(held)
    for shift in np.linspace(values[0] - 1, values[-1] + 1, 23):
        assert contour.below(held, shift) == (values < shift).sum()
    assert contour.below(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def test_query_equals_dense_numpy(spark, sf_dir):
    rows = [(x.vec_id, x.embedding) for x in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(rows, whitening.query(spark, sf_dir).collect())


def test_edge_rows(spark):
    pick = np.random.default_rng(1)
    rows = [(i, pick.standard_normal(5).tolist()) for i in range(40)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (None, [0.5] * 5), (50, None), (51, [1.0, None, 0.0, 0.0, 0.0]),
             (52, [float("nan")] * 5), (53, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (54, []), (55, [1.0, 2.0]),
             (56, [-1.0] * 5), (57, [3e4, -3e4, 1.0, 2.0, 0.0])]
    check(rows, whitening.whiten(table(spark, rows)).collect())


def test_nothing_to_whiten(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [float("nan")])])).count() == 0
    assert whitening.whiten(table(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).count() == 0
    few = [(1, [0.5, 0.25, 0.0]), (2, [0.5, 0.75, 1.0])]
    check(few, whitening.whiten(table(spark, few)).collect())
