"""Samples, cells and perforations along tracks equal plain loops, and no table of samples is sent whole to the driver."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidewell.operators import geometry

TRACK = "model BIGINT, well STRING, seq INT, x DOUBLE, y DOUBLE, z DOUBLE, md DOUBLE"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _samples(rows, step):
    """As sample_track, a well after the other."""
    out = {}
    for key in {r[:2] for r in rows if None not in r[:2]}:
        t = sorted((r for r in rows if r[:2] == key), key=lambda r: r[2])
        a, b = t[0][6], t[-1][6]
        if len(t) < 2 or not b > a:
            continue
        n = max(2, math.ceil((b - a) / step) + 1)
        for s in range(n):
            at = b if s == n - 1 else a + (b - a) * s / (n - 1)
            for p, q in zip(t, t[1:], strict=False):
                if p[6] <= at <= q[6]:
                    f = (at - p[6]) / (q[6] - p[6]) if q[6] > p[6] else 0.0
                    out[(*key, s)] = (at, *(p[c] + (q[c] - p[c]) * f for c in (3, 4, 5)))
                    break
    return out


def test_samples_without_a_join(spark):
    r = np.random.default_rng(3)
    rows = [(9, "one", 0, 1.0, 1.0, 1.0, 0.0), (9, "none", 0, 1.0, 1.0, 1.0, 4.0), (9, "none", 1, 1.0, 1.0, 2.0, 4.0), (None, "W", 0, 0.0, 0.0, 0.0, 0.0), (None, "W", 1, 1.0, 1.0, 1.0, 9.0)]
    for well in range(25):
        md = np.round(np.cumsum(r.uniform(-1, 6, r.integers(2, 9))) * 4) / 4  # depths that stand still or go back are among them
        rows += [(well % 3, f"W{well}", n, *map(float, r.uniform(0, 50, 3)), float(d)) for n, d in enumerate(md)]
    got = geometry.sample_track(spark.createDataFrame(rows, TRACK).repartition(5), 0.5)
    assert "Join" not in _plan(got) and "Broadcast" not in _plan(got)
    have = {(q.model, q.well, q.s): (q.md, q.x, q.y, q.z) for q in got.collect()}
    want = _samples(rows, 0.5)
    assert have.keys() == want.keys() and len(have) > 300
    assert all(np.allclose(have[k], want[k], atol=1e-9) for k in want)


def test_cells_of_crowded_squares(spark, monkeypatch, tmp_path):
    """Points of a square are dealt over tasks; equal ones all stay, and pillars in small files are not sent to the driver."""
    monkeypatch.setattr(geometry, "A_SQUARE", 7, raising=False)
    spark.createDataFrame([(i, j, i * 10.0 + j, j * 8.0 + 0.5 * i) for i in range(8) for j in range(6)], "i INT, j INT, x DOUBLE, y DOUBLE").write.parquet(str(tmp_path / "pillars"))
    quads = geometry.grid_quads(spark.read.parquet(str(tmp_path / "pillars"))).drop("cx", "cy")
    assert "Broadcast" not in _plan(quads)
    r = np.random.default_rng(4)
    rows = [(1, "W", n, *map(float, p)) for n, p in enumerate(np.concatenate([r.uniform(-5, 30, (120, 2)), r.uniform(12, 14, (60, 2)), [[10.0, 0.5], [21.0, 9.0]]]))]
    rows += [(2, "twice", 0, 13.0, 9.0)] * 2 + [(2, "null", 0, None, 9.0)]
    got = geometry.locate(spark.createDataFrame(rows, "model BIGINT, well STRING, s INT, x DOUBLE, y DOUBLE").repartition(3), quads, 12.0)
    cells = [q.asDict() for q in quads.collect()]

    def cell(x, y):
        best = None
        for c in cells if x is not None else ():
            z = [(c[f"x{(n + 1) % 4}"] - c[f"x{n}"]) * (y - c[f"y{n}"]) - (c[f"y{(n + 1) % 4}"] - c[f"y{n}"]) * (x - c[f"x{n}"]) for n in range(4)]
            if min(z) >= 0 or max(z) <= 0:
                d = (x - sum(c[f"x{n}"] for n in range(4)) / 4) ** 2 + (y - sum(c[f"y{n}"] for n in range(4)) / 4) ** 2
                best = min(best or (d, c["j"], c["i"]), (d, c["j"], c["i"]))
        return (best[2], best[1]) if best else (None, None)

    key = lambda q: tuple("" if x is None else str(x) for x in q)
    assert sorted(map(tuple, got.select("model", "well", "s", "x", "y", "i", "j").collect()), key=key) == sorted(((*p, *cell(*p[3:])) for p in rows), key=key)


def test_layers_kept_off_the_driver(spark, tmp_path):
    spark.createDataFrame([(i, 0, k, 10.0 * k + i, 10.0 * k + 10 + i) for i in range(3) for k in range(4)], "i INT, j INT, k INT, z_top DOUBLE, z_bot DOUBLE").write.parquet(str(tmp_path / "layers"))
    rows = [(1, "W", 0, 5.0, 0, 0), (1, "W", 0, 5.0, 0, 0), (1, "W", 1, 10.0, 0, 0), (1, "W", 2, 10.0, 1, 0), (1, "W", 3, 99.0, 1, 0), (1, "W", 4, 5.0, None, None), (1, "W", 5, None, 1, 0)]
    got = geometry.bracket(spark.createDataFrame(rows, "model BIGINT, well STRING, s INT, z DOUBLE, i INT, j INT"), spark.read.parquet(str(tmp_path / "layers")))
    assert "Broadcast" not in _plan(got) and got.columns[-1] == "k"
    assert sorted((q.s, q.k) for q in got.where("s < 3").collect()) == [(0, 0), (0, 0), (1, 0), (2, 0)]
    assert sorted((q.s, q.k) for q in got.where("s > 2").collect()) == [(3, None), (4, None), (5, None)]


def test_spans_are_not_grouped_by_intervals(spark):
    spans = spark.createDataFrame([(1, "W", 0.0, 5.0), (1, "W", 30.0, 20.0), (1, "W", 5.0, 5.0), (1, "V", 0.0, 1.0), (2, "W", 0.0, 1.0), (1, "N", 0.0, 9.0), (None, "W", 0.0, 1.0)], "model INT, well STRING, md_in DOUBLE, md_out DOUBLE")
    perfs = spark.createDataFrame([(1, "W", 9.0, 12.0), (1, "W", 25.0, 26.0), (1, "V", 1.0, 2.0), (1, "N", None, 5.0), (1, "N", 8.0, 8.5)], "model INT, well STRING, md_low DOUBLE, md_high DOUBLE")
    got = geometry.perforated(spans, perfs)
    assert "bool_or" not in _plan(got) and "max(_known" not in _plan(got)
    have = {(q.model, q.well, q.md_in): q.perforated for q in got.collect()}
    assert have == {(1, "W", 0.0): False, (1, "W", 30.0): True, (1, "W", 5.0): False, (1, "V", 0.0): False, (2, "W", 0.0): True, (1, "N", 0.0): True, (None, "W", 0.0): True}


def test_traverse_on_files(spark, tmp_path):
    """Tables in small files, whose rows are many more than their size tells, are not sent to the driver on the way to cells and descriptors."""
    t = [(1, "W", n, 5.0 + n, 5.0, 10.0 * n, 10.0 * n) for n in range(4)]
    spark.createDataFrame(t, TRACK).write.parquet(str(tmp_path / "tracks"))
    spark.createDataFrame([(i, j, i * 10.0, j * 10.0) for i in range(3) for j in range(3)], "i INT, j INT, x DOUBLE, y DOUBLE").write.parquet(str(tmp_path / "pillars"))
    cells = [(1, i, j, k, 10.0 * k, 10.0 * k + 10, 200.0, 1.0) for i in range(2) for j in range(2) for k in range(3)]
    spark.createDataFrame(cells, "model BIGINT, i INT, j INT, k INT, z_top DOUBLE, z_bot DOUBLE, permx DOUBLE, ntg DOUBLE").write.parquet(str(tmp_path / "cells"))
    tracks, pillars, cells = (spark.read.parquet(str(tmp_path / n)) for n in ("tracks", "pillars", "cells"))
    perfs = tracks.groupBy("model", "well").agg(F.lit(0.0).alias("md_low"), F.lit(12.0).alias("md_high"))
    runs = geometry.traverse(tracks, geometry.grid_quads(pillars).drop("cx", "cy"), cells.select("i", "j", "k", "z_top", "z_bot"), perfs, 0.5, 10.0)
    # what is grouped by a shuffle first has its true size known before it is sent; nothing else may be
    for sent in _plan(runs).split("BroadcastExchange")[1:]:
        assert "Aggregate" in "".join(sent.splitlines()[1:4])
    assert [(r.i, r.j, r.k, r.perforated) for r in runs.orderBy("k").collect()] == [(0, 0, 0, True), (0, 0, 1, True), (0, 0, 2, False)]


def test_cells_of_descriptors_kept_off_the_driver(spark, tmp_path):
    from tidewell.operators import geology

    spark.createDataFrame([(1, 0, 0, k, 200.0, 1.0) for k in range(3)], "model INT, i INT, j INT, k INT, permx DOUBLE, ntg DOUBLE").write.parquet(str(tmp_path / "cells"))
    runs = spark.createDataFrame([(1, "W", 0, 0, k, 5.0, k > 0) for k in range(3)], "model INT, well STRING, i INT, j INT, k INT, dz_eff DOUBLE, perforated BOOLEAN")
    got = geology.well_descriptors(runs, spark.read.parquet(str(tmp_path / "cells")), 100.0)
    assert "Broadcast" not in _plan(got)
    assert (got.first().n_cells_traversed, got.first().net_sand_penetrated, got.first().kh_penetrated) == (3, 10.0, 2000.0)
