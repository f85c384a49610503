import json

import pytest
from pyspark.sql import functions as F

from tidewell.functions.columns import status
from tidewell.operators import geology as geo
from tidewell.operators import geometry
from tidewell.sources import decks, sinks, tables


def test_spread_block(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in range(1, 6)] + [("b", 2.0)], "g STRING, value DOUBLE")
    got = {r.g: r for r in geo.spread_block(rows, ["g"]).collect()}
    assert (got["a"].n, got["a"].mean, got["a"].p50, got["a"]["range"]) == (5, 3, 3, 4)
    assert got["a"].std == pytest.approx(2.5**0.5) and got["b"].std == 0


@pytest.mark.parametrize(
    ("old", "new", "d", "want"),
    [
        (0.1, 0.95, ">", "BETTER"), (0.1, 0.95, "<", "WORSE"), (1.0, 1.0005, ">", "NEUTRAL"), (1.0, 2.0, "~", "NEUTRAL"),
        (None, 2.0, ">", "NEUTRAL"), (0.0, 1e-10, ">", "NEUTRAL")
    ]
)
def test_status(spark, old, new, d, want):
    df = spark.createDataFrame([(old, new, d)], "o DOUBLE, n DOUBLE, d STRING")
    assert df.select(status("o", "n", "d").alias("s")).first().s == want


def test_watercut(spark):
    rows = spark.createDataFrame(
        [(1, "cum", "o", "A", 9, 10.0), (1, "cum", "w", "A", 9, 30.0), (1, "cum", "o", "B", 9, 0.0), (1, "cum", "w", "B", 9, 0.0)],
        "member_id BIGINT, kind STRING, metric STRING, well STRING, time BIGINT, value DOUBLE"
    )
    got = {r.well: r.watercut for r in geo.year_end_responses(rows, 9, "o", "w").collect()}
    assert got == {"A": 0.75, "B": None}


def test_compliance(spark):
    rows = spark.createDataFrame(
        [(s, m + 10 * c, c, 1.0 * m, 4.0 * m, 9.0 * m) for s in ("a", "b") for c in range(3) for m in range(5)],
        "setup STRING, model_id BIGINT, cluster_id BIGINT, dev_field_cum_pct DOUBLE, dev_field_annual_max_pct DOUBLE, dev_well_top80_max_pct DOUBLE"
    )
    out = geo.compliance_summary(geo.compliance(rows))
    assert out.count() == 8 and out.where("cluster = -1").first().n == 15
    with pytest.raises(ValueError):
        geo.model_misfit(rows)


def test_descriptors(spark):
    cells = spark.createDataFrame(
        [(1, 0, 0, k, p, 1.0) for k, p in enumerate((100.0, 500.0, 200.0))], "model BIGINT, i INT, j INT, k INT, permx DOUBLE, ntg DOUBLE"
    )
    t = spark.createDataFrame(
        [(1, "W", 0, 0, k, 5.0, k != 2) for k in range(3)],
        "model BIGINT, well STRING, i INT, j INT, k INT, dz_eff DOUBLE, perforated BOOLEAN"
    )
    r = geo.well_descriptors(t, cells, 50.0).first()
    assert (r.net_sand_penetrated, r.kh_penetrated, r.n_sand_cells, r.n_cells_perforated) == (10, 3000, 3, 2)


def _cells(spark, points):
    return spark.createDataFrame([(1, (k * 5 + j) * 5 + i, i, j, k) for i, j, k in points], "model BIGINT, flat BIGINT, i INT, j INT, k INT")


def test_bodies(spark):
    mask = _cells(spark, [(0, 0, 0), (1, 1, 1)])
    n = lambda df: df.select("body").distinct().count()
    assert n(geometry.label_bodies(mask, 6)) == 2 and n(geometry.label_bodies(mask, 26)) == 1
    with pytest.raises(ValueError):
        geometry.label_bodies(mask, 18)


def test_bodies_both_ways(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    mask = _cells(spark, [(i, j, k) for i in range(5) for j in range(5) for k in range(3) if (i * 7 + j * 3 + k * 5) % 4 < 2])
    for c in (6, 26):
        a = {r.flat: r.body for r in geometry.label_bodies(mask, c).collect()}
        b = {r.flat: r.body for r in geometry.label_bodies_spread(mask, c).collect()}
        assert a == b


@pytest.mark.parametrize(("points", "angle"), [([(0, 0), (1, 0), (2, 0)], 0), ([(0, 0), (1, 1), (2, 2)], 45), ([(0, 0), (0, 1), (0, 2)], 90), ([(0, 0)], 0)])
def test_axes(spark, points, angle):
    df = spark.createDataFrame([(1, float(x), float(y)) for x, y in points], "g INT, x DOUBLE, y DOUBLE")
    r = geometry.principal_axes(df, ["g"]).first()
    assert abs(r.angle) == pytest.approx(angle) and (r.major > 0) == (len(points) > 1)


def test_vertical_well(spark):
    tracks = spark.createDataFrame(
        [(1, "W", 0, 5.0, 5.0, 0.0, 0.0), (1, "W", 1, 5.0, 5.0, 30.0, 30.0), (1, "V", 0, 5.0, 5.0, 0.0, 0.0)],
        "model BIGINT, well STRING, seq INT, x DOUBLE, y DOUBLE, z DOUBLE, md DOUBLE"
    )
    pillars = spark.createDataFrame([(i, j, i * 10.0, j * 10.0) for i in range(3) for j in range(3)], "i INT, j INT, x DOUBLE, y DOUBLE")
    layers = spark.createDataFrame(
        [(i, j, k, 10.0 * k, 10.0 * k + 10) for i in range(2) for j in range(2) for k in range(3)],
        "i INT, j INT, k INT, z_top DOUBLE, z_bot DOUBLE"
    )
    perfs = spark.createDataFrame([(1, "W", 10.0, 30.0)], "model BIGINT, well STRING, md_low DOUBLE, md_high DOUBLE")
    got = geometry.traverse(tracks, geometry.grid_quads(pillars).drop("cx", "cy"), layers, perfs, 0.5, 10.0).orderBy("k").collect()
    assert [(r.i, r.j, r.k) for r in got] == [(0, 0, 0), (0, 0, 1), (0, 0, 2)]
    assert all(9 <= r.dz_eff <= 10 for r in got) and [r.perforated for r in got] == [False, True, True]


def test_runs_drop_nulls(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(["a", "a", None, "a", "b"])], "g INT, t INT, s STRING")
    assert [(r.s, r.n) for r in geometry.runs(rows, ["g"], ["t"], "s").orderBy("first").collect()] == [("a", 2), ("a", 1), ("b", 1)]


def test_cube_parser():
    assert decks.read_cube("-- c\nPORO\n3*1 2*0 1 /\n", "poro", 6) == [1, 1, 1, 0, 0, 1]
    assert decks.read_cube("SATNUM\n1.9 2 /", "SATNUM", 2, integer=True) == [1, 2]
    for bad in ("NTG\n1 /", "PORO\n1 2 3 /", "PORO\n1 /", "PORO\n1 x /", "PORO\n1 2"):
        with pytest.raises(decks.DeckError):
            decks.read_cube(bad, "PORO", 2)


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("1_2-345.data", (1, 345, False)), ("2_centroid.data", (2, None, True)), ("centroid.data", (None, None, True)),
        ("run.data", (None, None, False))
    ]
)
def test_deck_names(name, want):
    assert decks.deck_key(name) == want


def test_tracks_and_perforations():
    t = decks.read_tracks("WELLTRACK 'A'\n1 2 3 0\nbad\n1 2 4 1 /\nWELLTRACK 'B'\n/\n")
    assert t == {"A": [(1, 2, 3, 0), (1, 2, 4, 1)]}
    assert decks.read_perforations("COMPDATMD\n'A' 1 5 9 MD OPEN /\n'A' 1 1 2 MD SHUT /\n/\nCOMPDATMD\n'C' 1 5 9 MD OPEN /\n/") == {"A": [(5, 9)]}
    g = decks.read_grid("SPECGRID\n2 3 4 /\nCOORD\n1 x /\n")
    assert (g["nx"], g["ny"], g["nz"], g["coord"], g["zcorn"]) == (2, 3, 4, None, None)


def test_ensemble_reader(spark):
    man = spark.createDataFrame([(1, 7, 100, 0), (1, 8, 101, 1), (1, 7, 102, 2)], "cluster_id BIGINT, seed BIGINT, model_id BIGINT, ord BIGINT")
    rows = [("51-1_1-7", "oil", "A", t, 1.0) for t in range(3)] + [("51-1_1-8", "oil", "A", t, 1.0) for t in range(2)] + [("notes", "oil", "A", 0, 1.0)]
    dyn = spark.createDataFrame(rows, "sheet STRING, metric STRING, well STRING, time BIGINT, value DOUBLE")
    out = tables.load_ensemble(man, dyn)
    assert {r.model_id for r in out.collect()} == {101}  # the first by order fixes the length: seed 8 has order 1, the last row of seed 7 order 2
    with pytest.raises(ValueError):
        tables.load_ensemble(man, dyn.where("sheet = 'notes'"))
    with pytest.raises(Exception, match="missing value"):
        tables.load_ensemble(man, dyn.withColumn("value", F.lit(float("nan")))).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b")], "x INT, s STRING")
    p = sinks.write_table(df, f"{tmp_path}/t")
    assert spark.read.parquet(p).count() == 1
    assert sinks.write_tables({"a": df, "bounds": df.limit(0)}, str(tmp_path), "csv", ("bounds",)) == [f"{tmp_path}/a"]
    assert sinks.config_hash({"b": 1, "a": 2}) == sinks.config_hash({"a": 2, "b": 1})
    assert sinks.write_sidecar(spark, p, "t", {}, 1)["seed"] == 1
    page = sinks.html_report("r", {"t": df, "e": df.limit(0)})
    assert "a&lt;b" in page and "no rows" in page
    assert tables.read_or_empty(spark, f"{tmp_path}/none", "a BIGINT").count() == 0
    n = []
    for _ in range(2):
        tables.cached(spark, f"{tmp_path}/c", lambda: n.append(1) or df)
    assert len(n) == 1


def test_cutoff(spark):
    import numpy as np

    r = np.random.default_rng(1)
    two = np.concatenate([10 ** r.normal(0, 0.15, 3000), 10 ** r.normal(3, 0.15, 3000)])
    df = spark.createDataFrame([("two", float(x)) for x in two] + [("few", 5.0)], "g STRING, permx DOUBLE")
    got = {x.g: x.cutoff for x in geometry.perm_cutoff(df, ["g"], fallback=-1.0).collect()}
    assert got["few"] == -1 and got["two"] > 0


def test_cube_difference_without_a_cube(spark):
    """A pair of which one model lacks a cube stays, with that cube's fields null."""
    cells = [(m, f, f, 0, 0, None if m == 2 else 0.1 * f + m, float(f * m), float((f + m) % 2)) for m in (1, 2, 3) for f in range(6)]
    df = spark.createDataFrame(cells, "model long, flat long, i int, j int, k int, poro double, permx double, ntg double")
    pairs = spark.createDataFrame([(7, 1, 2), (8, 1, 3)], "seed long, model_a long, model_b long")
    got = {r.seed: r for r in geo.cube_difference(df, df, pairs).collect()}
    assert got[7].mean_poro_b is None and got[7].delta_poro is None and got[7].delta_var_poro is None and got[7].delta_permx == pytest.approx(2.5)
    assert got[8].delta_poro == pytest.approx(2) and got[8].delta_var_poro == pytest.approx(0) and got[8].delta_var_permx == pytest.approx(8 * 35 / 12) and got[7].frac_netflag_changed == 1
    none = geo.cube_difference(df, df.withColumn("ntg", F.lit(None).cast("double")), pairs).first()
    assert none.frac_net_b is None and none.frac_netflag_changed is None and none.delta_frac_net is None


def test_sidecar_names_the_revision(spark, tmp_path):
    row = sinks.write_sidecar(spark, f"{tmp_path}/x", "theta", {"a": 1}, 7, n=3)
    held = json.loads(spark.read.text(f"{tmp_path}/x.meta").first().value)
    assert held == row and held["seed"] == 7 and held["extra"] == {"n": 3} and held["config_hash"] == sinks.config_hash({"a": 1})
    assert (held["revision"] is None) == (held["dirty"] is None) and (held["revision"] is None or len(held["revision"]) == 40)
