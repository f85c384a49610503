"""Quantiles by passes equal percentile; curves are near the direct sum."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import quantiles, series


def _rows(spark, table, kind="g string, value double"):
    return spark.createDataFrame(table, kind).repartition(3)


@pytest.mark.parametrize("most", [quantiles.MOST_BROADCAST, 0])
def test_passes_equal_percentile(spark, monkeypatch, most):
    monkeypatch.setattr(quantiles, "MOST_BROADCAST", most)
    r = np.random.default_rng(1)
    table = [("wide", float(x)) for x in r.normal(0, 1, 101) * 10.0 ** r.integers(-300, 300, 101)]
    table += [("ties", float(x)) for x in r.integers(-2, 3, 500)] + [("one", -0.0)] + [("two", -1.5), ("two", 1e-320)]
    table += [(None, float(x)) for x in r.random(77)] + [("none", None), ("none", float("nan")), ("some", None), ("some", 4.0)]
    table += [("ends", float("inf")), ("ends", float("-inf")), ("ends", 0.0)]
    q = (0.0, 0.1, 0.333, 0.5, 0.9, 1.0)
    df = _rows(spark, table)
    got = {x.g: tuple(x)[1:] for x in quantiles.exact_quantiles(df, ["g"], q).collect()}
    want = {x.g: tuple(x)[1:] for x in series.column_quantiles(df.where("not isnan(value)"), q, ["g"]).collect()}
    assert set(got) == set(want) - {"none"}
    for g in got:
        assert got[g] == pytest.approx(want[g], rel=1e-12, nan_ok=True), g


def test_order_of_bits():
    v = np.array([-np.inf, -1e300, -1.0, -1e-320, 0.0, 1e-320, 1.0, 1e300, np.inf])
    u = quantiles._turned(v.view(np.int64))
    assert (np.diff(u) > 0).all() and (quantiles._turned(u).view(np.float64) == v).all()


def test_no_rows(spark):
    assert quantiles.exact_quantiles(_rows(spark, []), ["g"]).count() == 0 and quantiles.density(_rows(spark, []), ["g"]).count() == 0


def test_density_is_near_the_direct_sum(spark):
    r = np.random.default_rng(2)
    groups = {"a": r.normal(0, 2, 800), "b": np.concatenate([r.normal(-3, 0.5, 300), r.normal(4, 1, 200)]), "c": np.array([1.0, 2.0])}
    df = _rows(spark, [(g, float(x)) for g, v in groups.items() for x in v] + [("flat", 1.0)] * 5 + [("one", 2.0), ("a", None), ("b", float("nan"))])
    got = quantiles.density(df, ["g"], points=50).toPandas()
    assert set(got["g"]) == set(groups)
    for g, v in groups.items():
        h = v.std(ddof=1) * len(v) ** -0.2
        mine = got[got.g == g].sort_values("x")
        x = np.linspace(v.min() - 3 * h, v.max() + 3 * h, 50)
        want = np.exp(-(((x[:, None] - v) / h) ** 2) / 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))
        assert np.abs(mine["x"] - x).max() < 1e-9 and np.abs(mine["density"] - want).max() < 1e-4 * want.max()
        assert abs(np.trapezoid(mine["density"], x) - 1) < 0.02


def test_quantiles_of_two_keys(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("a"), F.when(F.col("id") % 2 == 0, "x").alias("b"), (F.col("id") * 1.5).alias("value"))
    key = lambda q: sorted(map(tuple, q.collect()), key=repr)
    assert key(quantiles.exact_quantiles(df, ["a", "b"])) == key(series.column_quantiles(df, keys=["a", "b"]))
