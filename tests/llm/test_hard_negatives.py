"""Hard negatives against a plain search."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postwatch.llm import hard_negatives
from tests.check_oracles import compare, connect

SCHEMA = "vec_id long, embedding array<double>, label int, anchor int, score long, g int, x string"


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95):
    kept = [(i, label, [int(np.floor(256 * c)) for c in v]) for i, v, label in rows
            if i is not None and label is not None and v
            and all(c is not None and np.isfinite(c) for c in v)]
    lengths = [len(v) for *_, v in kept]
    size = max(set(lengths), key=lambda n: (lengths.count(n), n), default=0)
    kept = [x for x in kept if len(x[2]) == size]
    out = []
    for a, (i, label, v) in enumerate(kept):
        if i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), j, other == label)
                        for b, (j, other, w) in enumerate(kept) if b != a)
        for score, j, _ in [x for x in scored if x[2]][:positives]:
            fit = [x for x in scored if not x[2] and low * -score <= 100 * -x[0] <= high * -score]
            out += [(i, j, rank + 1, k, -score, -s) for rank, (s, k, _) in enumerate(fit[:negatives])]
    return Counter(out)


def mined(spark, rows, every=50, **numbers):
    frame = spark.createDataFrame([(i, v, label, 0, 0, 0, "x") for i, v, label in rows], SCHEMA)
    held = hard_negatives.usable(frame.repartition(3))
    return Counter(tuple(x) for x in hard_negatives.mine(held, F.col("vec_id") % every == 0, **numbers).collect())


def groups(count, size=6, spread=0.2, seed=0):
    """Vectors around a few centres, with labels that do not follow the centres."""
    pick = np.random.default_rng(seed)
    centres = pick.standard_normal((5, size))
    return [(i, (centres[i % 5] + spread * pick.standard_normal(size)).tolist(), int(pick.integers(4)))
            for i in range(count)]


def test_query_equals_its_sql(spark, sf_dir):
    frame = hard_negatives.query(spark, sf_dir).toPandas()
    assert len(frame)
    assert compare(frame, connect(sf_dir).execute(hard_negatives.ORACLE).df()) is None


@pytest.mark.parametrize("spread", [0.0, 0.05, 0.5])
def test_all_of_a_plain_search_is_found(spark, monkeypatch, spread):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 37)
    monkeypatch.setattr(hard_negatives, "TREE_ANCHORS", 10)
    monkeypatch.setattr(hard_negatives, "SHARED_BYTES", 2_000)
    monkeypatch.setattr(hard_negatives, "TASK_PAIRS", 500)
    rows = groups(300, spread=spread)
    assert mined(spark, rows, every=4) == brute(rows, every=4)


def test_edge_rows(spark):
    rows = groups(60, seed=2)
    rows += [rows[0], rows[0], rows[5], (50, rows[10][1], 1), (50, rows[11][1], 1), (None, rows[3][1], 1),
             (100, None, 1), (150, rows[2][1], None), (200, [1.0, None] * 3, 2), (250, [float("nan")] * 6, 2),
             (300, [float("inf")] * 6, 2), (350, [], 1), (400, [1.0], 1), (450, [0.0] * 6, 3), (-50, rows[1][1], 0)]
    assert mined(spark, rows, every=10) == brute(rows, every=10)
    assert mined(spark, rows, every=10, positives=2, negatives=7, low=-20, high=120) == brute(
        rows, 10, 2, 7, -20, 120)


@pytest.mark.parametrize("scale", [1e4, 1e6, 2.2e6, 1e9])
def test_large_entries_stay_exact(spark, scale):
    rows = [(i, [scale * c for c in v], label) for i, v, label in groups(60, size=3, seed=4)]
    if scale > 1e8:
        with pytest.raises(Exception, match="64 bits"):
            mined(spark, rows, every=10)
    else:
        assert mined(spark, rows, every=10) == brute(rows, every=10)


def test_no_anchors_and_no_rows(spark):
    assert not mined(spark, [])
    assert not mined(spark, [(1, [1.0], 1), (2, [1.0], 2)])
    assert not mined(spark, [(50, [1.0], 1)])


def test_trees_are_smallest_and_release_parents():
    points = np.random.default_rng(1).integers(-50, 50, (80, 3))
    order, parent, edge = hard_negatives.spanning_tree(points)
    assert sorted(order.tolist()) == list(range(80)) and parent[0] == -1
    away = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    assert np.allclose(edge[1:], away[order[1:], order[parent[1:]]])
    joined, total = {0}, 0.0
    while len(joined) < 80:
        inside = sorted(joined)
        outside = [i for i in range(80) if i not in joined]
        near = away[np.ix_(inside, outside)]
        total += near.min()
        joined.add(outside[int(near.argmin()) % len(outside)])
    assert edge.sum() == pytest.approx(total)
    last, live, most = {}, set(), 0
    for at, up in enumerate(parent.tolist()):
        last[up] = at
    for at, up in enumerate(parent.tolist()):
        if last[up] == at:
            live.discard(up)
        if at in last:
            live.add(at)
        most = max(most, len(live))
    assert most <= 8


def test_bounds_spare_scores():
    """Anchors that lie close together are hardly scored again."""
    pick = np.random.default_rng(0)
    points = pick.integers(-100, 100, 32) + pick.integers(-1, 2, (60, 32))
    order, parent, edge = hard_negatives.spanning_tree(points)
    anchors = hard_negatives.Anchors(pa.table({
        "g": pa.array([0] * 60), "at": pa.array(range(60)), "parent": pa.array(parent), "edge": pa.array(edge),
        "vec_id": pa.array(range(60)), "label": pa.array([0] * 60), "x": pa.array(points[order].tolist())}))
    batch = pa.record_batch({"vec_id": pa.array(range(2000)), "label": pa.array([1] * 2000),
                             "x": pa.array(pick.integers(-100, 100, (2000, 32)).tolist())})
    block = hard_negatives.Block(batch, anchors)
    exact = block.x @ anchors.x.T
    low, high, seen = np.full(60, 60_000.0), np.full(60, 70_000.0), 0
    for at, rows, scores in block.walk(low, high, alike=False):
        assert (scores == exact[rows, at]).all()
        assert set(np.flatnonzero((exact[:, at] >= 60_000) & (exact[:, at] <= 70_000))) <= set(rows.tolist())
        seen += len(rows) if at else 0
    assert seen < 0.2 * 59 * 2000
