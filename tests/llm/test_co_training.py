"""Co-training: the executors' sums against those in memory, and what each view teaches the other."""

from __future__ import annotations

import numpy as np
import pytest

from edgetide.llm import quality_classifier as q


def two_views(n=2000, seed=3):
    """Each view tells the class by its first column in its own half of the rows, weakly in the other; labels are few."""
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.6).astype(float)
    half = rng.random(n) < 0.5
    sign = 2 * y - 1
    a, b = rng.normal(0, 1, (n, 2)), rng.normal(0, 1, (n, 3))
    a[:, 0] += np.where(half, 3, 0.7) * sign
    b[:, 0] += np.where(half, 0.7, 3) * sign
    b[:, 1] += 1.5 * sign
    return [a, b], y


def stored(spark, x):
    rows = [(i, [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(*x, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, content array<float>, metadata array<float>").repartition(3)


def test_sums_on_executors_are_those_in_memory(spark):
    x, y = two_views(400)
    x = [v.astype(np.float32).astype(np.float64) for v in x]
    views = [q.View.fit(v[:40], y[:40]) for v in x]
    memory, table = q.Rows(x), q.Table(stored(spark, x))
    assert (memory.histograms(views) == table.histograms(views)).all()
    bounds = [q.cuts(c, 0.2, 0.6) for c in memory.histograms(views)]
    for a, b in zip(memory.sums(views, bounds), table.sums(views, bounds), strict=True):
        assert a == pytest.approx(b)


def test_both_views_teach():
    x, y = two_views()
    views = [q.View.fit(v[:24], y[:24]) for v in x]
    before = [np.mean((v.raw(p[1000:]) > 0) == (y[1000:] > 0.5)) for v, p in zip(views, x, strict=True)]
    handed = q.teach(views, [v[:24] for v in x], y[:24], q.Rows([v[24:1000] for v in x]), 4, 0.2)
    after = [np.mean((v.raw(p[1000:]) > 0) == (y[1000:] > 0.5)) for v, p in zip(views, x, strict=True)]
    assert {h[1] for h in handed} == {"content", "metadata"}
    # Rows of both classes go each way in every round, and move the other's weights.
    assert all(0 < good < rows and change > 1e-4 for _, _, rows, good, change in handed)
    assert sum(after) > sum(before) and min(after) > 0.75


def test_a_worthless_view_teaches_nothing():
    x, y = two_views(1200)
    x[1] = np.random.default_rng(1).normal(0, 1, x[1].shape)
    views = [q.View.fit(v[:200], y[:200]) for v in x]
    content = views[0].weights.copy()
    views[1].calibration = (0.0, 0.0)
    q.teach(views, [v[:200] for v in x], y[:200], q.Rows([v[200:] for v in x]), 1, 0.1)
    assert np.abs(views[0].weights - content).max() < 1e-6


@pytest.mark.parametrize("n", [0, 1, 50])
def test_small_pools(spark, n):
    x, y = two_views(100)
    for pool in (q.Rows([v[:n] for v in x]), q.Table(stored(spark, [v[:n] for v in x]))):
        views = [q.View.fit(v[50:], y[50:]) for v in x]
        handed = q.teach(views, [v[50:] for v in x], y[50:], pool, 2, 0.1)
        assert len(handed) == 4 and all(np.isfinite(v.weights).all() for v in views)


def test_cuts_by_rank():
    counts = np.zeros(q.BINS, dtype=int)
    counts[::64] = 10  # 640 rows
    top, low = q.cuts(counts, 0.1, 0.75)
    edges = np.linspace(-q.LIMIT, q.LIMIT, q.BINS + 1)
    assert counts[edges[:-1] >= top].sum() in (50, 60) and counts[edges[1:] <= low].sum() in (10, 20)
