"""Regressions from sums of products against least squares on all rows, folds and resamples in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import linear, regression


def _data(spark, n, seed=1, scale=1.0, parts=4):
    r = np.random.default_rng(seed)
    x = r.normal(3, 1, (n, 4)) * scale + [1e4, 0, -50, 0]
    x[:, 2] = x[:, 0] * 0.5 + r.normal(0, scale, n)
    y = x @ [1.0, -2.0, 0.3, 0.0] + r.normal(0, 2 * scale, n)
    rows = [(f"g{i % 3}" if i % 7 else None, i, *map(float, x[i]), float(y[i])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, id long, a double, b double, c double, d double, y double").repartition(parts)


def _r2(x, y):
    z = x - x.mean(0)
    e = y - y.mean() - z @ np.linalg.lstsq(z, y - y.mean(), rcond=None)[0]
    return 1 - (e**2).sum() / ((y - y.mean()) ** 2).sum()


def _hashes(df, seed, *key):
    return {r.id: r.h for r in df.select("id", regression.row_hash(seed, *key).alias("h")).collect()}


@pytest.mark.parametrize("scale", [1.0, 1e-6])
def test_uplift_equals_least_squares(spark, scale):
    rows, df = _data(spark, 400, scale=scale)
    got = {r.group: r for r in regression.r2_uplift(df, "g", ["a"], ["b", "c"], "y", 40, 5, ["id"]).collect()}
    h = _hashes(df, 5, "id")
    assert set(got) == {"g0", "g1", "g2", None}
    # the data themselves have ten digits fewer than 1e4 +- 1 has if they lie around 1e4 by a millionth
    fine = 1e-8 if scale == 1 else 1e-6
    for g, r in got.items():
        m = [x for x in rows if x[0] == g]
        z = np.array([x[2:] for x in m])
        hs = np.array([h[x[1]] for x in m])
        base, full, y = z[:, :1], z[:, :3], z[:, -1]
        assert r.n == len(m) and r.r2_base == pytest.approx(_r2(base, y), abs=fine) and r.r2_full == pytest.approx(_r2(full, y), abs=fine)
        scores = {1: [], 3: []}
        for k in range(5):
            t = hs % 5 == k
            for p in scores:
                mx, my = z[~t, :p].mean(0), y[~t].mean()
                b = np.linalg.lstsq(z[~t, :p] - mx, y[~t] - my, rcond=None)[0]
                e = y[t] - my - (z[t, :p] - mx) @ b
                scores[p].append(1 - (e**2).sum() / ((y[t] - y[t].mean()) ** 2).sum())
        assert r.r2_base_cv == pytest.approx(np.mean(scores[1]), abs=fine) and r.r2_full_cv == pytest.approx(np.mean(scores[3]), abs=fine)
        w = regression.draws(hs, 0, 40).astype(int)
        u = [_r2(np.repeat(full, k, 0), np.repeat(y, k)) - _r2(np.repeat(base, k, 0), np.repeat(y, k)) for k in w]
        assert (r.ci_low, r.ci_high) == pytest.approx(np.percentile(u, [2.5, 97.5]), abs=fine)


def test_coefficients_and_signs(spark):
    rows, df = _data(spark, 300)
    got = {(r.group, r.predictor): r for r in regression.src2(df, "g", ["a", "b", "d"], "y", 200, 5, ["id"]).collect()}
    z = np.array([x[2:] for x in rows if x[0] == "g1"])
    x = z[:, [0, 1, 3]]
    b = np.linalg.lstsq((x - x.mean(0)) / x.std(0), z[:, -1] - z[:, -1].mean(), rcond=None)[0] / z[:, -1].std(ddof=1)
    assert [got["g1", c].src2 for c in "abd"] == pytest.approx(b**2) and got["g1", "b"].stability_fraction == 1 and 0.3 < got["g1", "d"].stability_fraction <= 1
    assert {r.n for (g, _), r in got.items() if g == "g1"} == {len(z)}


def test_partitions_and_flushes_change_nothing(spark, monkeypatch):
    _, df = _data(spark, 200)
    want = sorted(map(tuple, regression.r2_uplift(df.coalesce(1), "g", ["a"], ["b"], "y", 30, 1, ["id"]).collect()), key=repr)
    monkeypatch.setattr(regression, "_HELD", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(tuple, regression.r2_uplift(df.repartition(9), "g", ["a"], ["b"], "y", 30, 1, ["id"]).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for a, b in zip(got, want, strict=True):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], abs=1e-10)


def test_draws_are_poisson():
    h = np.random.default_rng(0).integers(0, regression.PRIME, 2000)
    w = regression.draws(h, 0, 500)
    assert abs(w.mean() - 1) < 0.005 and abs(w.var() - 1) < 0.01 and abs((w == 0).mean() - np.exp(-1)) < 0.003
    assert (regression.draws(h, 120, 30) == w[120:150]).all()
    c = np.corrcoef(w[:, :300].T)
    assert np.abs(c - np.eye(300)).max() < 0.35 and abs(c[np.triu_indices(300, 1)].mean()) < 0.002
    r = np.corrcoef(w[:200])
    assert abs(r[np.triu_indices(200, 1)].mean()) < 0.002


def test_interval_is_that_of_a_plain_bootstrap(spark):
    """Within what two sets of 600 resamples differ by."""
    rows, df = _data(spark, 600, seed=4)
    one = df.withColumn("g", F.lit("all"))
    r = regression.r2_uplift(one, "g", ["a"], ["b"], "y", 600, 2, ["id"]).first()
    z = np.array([x[2:] for x in rows])
    g = np.random.default_rng(1)
    u = [(lambda k: _r2(z[k][:, :2], z[k][:, -1]) - _r2(z[k][:, :1], z[k][:, -1]))(g.integers(0, 600, 600)) for _ in range(600)]
    width = np.percentile(u, 97.5) - np.percentile(u, 2.5)
    assert (r.ci_low, r.ci_high) == pytest.approx(np.percentile(u, [2.5, 97.5]), abs=0.15 * width)


def test_odd_groups(spark):
    """Missing values, constant and repeated predictors, constant responses, few rows, none at all."""
    r = np.random.default_rng(3)
    rows = [("flat", i, 1.0, float(r.normal()), float(r.normal()), 5.0) for i in range(20)]
    rows += [("twice", i, float(i), 2.0 * i, float(r.normal()), float(i % 7)) for i in range(20)]
    rows += [("few", i, float(i), float(r.normal()), float(r.normal()), float(i)) for i in range(4)]
    rows += [("twice", 99, None, 1.0, 1.0, 1.0), ("twice", 98, 1.0, float("nan"), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, id long, a double, b double, c double, y double")
    got = {x.group: x for x in linear.r2_uplift(df, "g", ["a"], ["b"], "y", 20, 1, ["id"]).collect()}
    assert got["twice"].n == 20 and got["twice"].uplift == pytest.approx(0, abs=1e-9) and got["flat"].r2_full is None and got["few"].r2_base is None and got["few"].n == 4 and got["few"].ci_low is None
    assert linear.src2(df, "g", ["a", "b"], "y", 20).where("group = 'twice'").count() == 2
    assert linear.r2_uplift(df.limit(0), "g", ["a"], ["b"], "y", 20).count() == 0 and linear.src2(df.limit(0), "g", ["a"], "y", 20).count() == 0
