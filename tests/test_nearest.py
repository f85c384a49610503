"""Nearest centres equal brute force on grids with cells of very different sizes."""

import numpy as np
import pytest

from tidewell.operators import geometry, nearest


def _brute(points, centres, k):
    out = {}
    for pid, x, y in points:
        if x is not None:
            d = sorted(((x - cx) ** 2 + (y - cy) ** 2, i) for i, cx, cy in centres)
            out[pid] = [i for _, i in d[:k]]
    return out


@pytest.mark.parametrize(("leaf", "k"), [(8, 6), (64, 6), (2, 3), (256, 1)])
def test_nearest_equal_brute_force(spark, monkeypatch, leaf, k):
    monkeypatch.setattr(nearest, "A_TASK", 40)
    r = np.random.default_rng(leaf)
    centres = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([r.normal(0, 0.01, (300, 2)), r.normal(0, 50, (60, 2)), r.uniform(-1000, 1000, (20, 2)), [[5.0, 5.0]] * 12]))]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([r.normal(0, 0.02, (200, 2)), r.uniform(-3000, 3000, (80, 2)), [[5.0, 5.0], [0.0, 0.0]]]))] + [(9999, None, 1.0)]
    got = {}
    df = nearest.nearest_centres(spark.createDataFrame(points, "pid long, x double, y double").repartition(3), spark.createDataFrame(centres, "id long, cx double, cy double").repartition(4), k, leaf)
    for q in sorted(df.collect(), key=lambda q: (q.pid, q.place)):
        got.setdefault(q.pid, []).append(q.id)
    assert got == _brute(points, centres, k)


def test_few_or_no_centres(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0)], "pid long, x double, y double")
    few = spark.createDataFrame([(7, 1.0, 1.0), (8, None, 0.0), (3, 8.0, 8.0)], "id long, cx double, cy double")
    assert sorted((q.pid, q.place, q.id) for q in nearest.nearest_centres(points, few).collect()) == [(1, 0, 7), (1, 1, 3), (2, 0, 3), (2, 1, 7)]
    assert nearest.nearest_centres(points, few.limit(0)).count() == 0 and nearest.nearest_centres(points.limit(0), few).count() == 0


def test_a_grid_with_one_long_column(spark):
    """Cells from a thousandth to a hundred wide: each point is in the cell that brute force finds among its six nearest."""
    r = np.random.default_rng(5)
    x = np.concatenate([[0], np.cumsum(np.concatenate([r.uniform(0.001, 0.01, 20), [100.0], r.uniform(0.5, 2, 9)]))])
    y = np.concatenate([[0], np.cumsum(r.uniform(0.2, 3, 15))])
    pillars = spark.createDataFrame([(i, j, float(a + 0.01 * b), float(b)) for i, a in enumerate(x) for j, b in enumerate(y)], "i int, j int, x double, y double")
    quads = geometry.grid_quads(pillars).drop("cx", "cy").cache()
    pts = [(0, "w", n, float(a), float(b)) for n, (a, b) in enumerate(zip(r.uniform(-1, x[-1] + 1, 300), r.uniform(-1, y[-1] + 1, 300), strict=True))]
    df = spark.createDataFrame(pts, "model long, well string, s long, x double, y double")
    got = {q.s: (q.i, q.j) for q in nearest.locate_nearest(df, quads, leaf=8).collect()}
    cells = [q.asDict() for q in quads.collect()]
    for _, _, s, a, b in pts:
        near = sorted(cells, key=lambda c: ((a - sum(c[f"x{n}"] for n in range(4)) / 4) ** 2 + (b - sum(c[f"y{n}"] for n in range(4)) / 4) ** 2, c["j"], c["i"]))[:6]
        hit = None, None
        for c in near:
            z = [(c[f"x{(n + 1) % 4}"] - c[f"x{n}"]) * (b - c[f"y{n}"]) - (c[f"y{(n + 1) % 4}"] - c[f"y{n}"]) * (a - c[f"x{n}"]) for n in range(4)]
            if min(z) >= 0 or max(z) <= 0:
                hit = c["i"], c["j"]
                break
        assert got[s] == hit
    assert sum(v[0] is not None for v in got.values()) > 100


def test_points_kept_off_the_driver(spark):
    pillars = spark.createDataFrame([(i, j, float(i), float(j)) for i in range(4) for j in range(4)], "i int, j int, x double, y double")
    points = spark.createDataFrame([(0, "w", n, n * 0.3, 0.5) for n in range(12)], "model long, well string, s long, x double, y double")
    got = nearest.locate_nearest(points, geometry.grid_quads(pillars).drop("cx", "cy"), leaf=4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # grouped tables may be sent, as their true size is known by then
    for sent in plan.split("BroadcastExchange")[1:]:
        assert "Aggregate" in "".join(sent.splitlines()[1:4])
    assert {q.s: q.i for q in got.collect()} == {n: int(n * 0.3) if n < 10 and n * 0.3 < 3 else None for n in range(12)} | {10: 2 if 10 * 0.3 <= 3 else None}
