"""Decks from real files to tables, the geology command, and the production link against dense formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell import __main__ as cli
from tidewell.operators import linear, members, production
from tidewell.plans import experiment

NX, NY, NZ, DX, DZ = 4, 3, 3, 10.0, 5.0


def _cube(keyword, values):
    return f"-- cube\nNOECHO\n{keyword}\n" + " ".join(f"{v:g}" for v in values) + "\n/\nECHO\n"


def write_deck(root, name, stem, permx, wells, perfs, ntg=None):
    inc = root / name / "INCLUDE"
    inc.mkdir(parents=True)
    (root / name / f"{stem}.data").write_text("RUNSPEC\n")
    n = NX * NY * NZ
    (inc / f"{stem}_GRID.inc").write_text(f"SPECGRID\n {NX} {NY} {NZ} 1 F /\nFAULTS\n'A' 1 1 2 2 1 3 'I' /\n'bad' 1 x 2 2 1 3 'I' /\n/\n")
    coord = [c for j in range(NY + 1) for i in range(NX + 1) for c in (i * DX, j * DX, 0, i * DX, j * DX, NZ * DZ)]
    zcorn = [DZ * (k + side) for k in range(NZ) for side in (0, 1) for _ in range(4 * NX * NY)]
    (inc / f"{stem}.grdecl").write_text(_cube("COORD", coord) + _cube("ZCORN", zcorn))
    (inc / f"{stem}_PORO.inc").write_text(_cube("PORO", [0.2] * n))
    (inc / f"{stem}_PERMX.inc").write_text(_cube("PERMX", permx))
    (inc / f"{stem}_NTG.inc").write_text(_cube("NTG", ntg or [1] * n))
    tracks = "".join(
        f"WELLTRACK '{w}'\n" + "".join(f"{x} {y} {z} {m}\n" for x, y, z, m in pts[:-1]) + " ".join(map(str, pts[-1])) + " /\n" for w,
        pts in wells.items()
    )
    (inc / f"{stem}_WELLTRACK.inc").write_text(tracks)
    if perfs:
        (inc / f"{stem}_SCHEDULE.inc").write_text("COMPDATMD\n" + "".join(f"'{w}' 1 {a} {b} MD OPEN /\n" for w, a, b in perfs) + "/\n")


def vertical(x, y):
    return [(x, y, 0.0, 0.0), (x, y, 15.0, 15.0)]


@pytest.fixture(scope="module")
def roots(tmp_path_factory):
    n = NX * NY * NZ
    out = {}
    for e in (1, 2):
        root = tmp_path_factory.mktemp(f"experiment {e}")
        # sand in the two outer columns of i, so two bodies; in the second experiment a bridge in layer 1 joins them
        permx = [500.0 if f % NX in (0, 3) or (e == 2 and f // (NX * NY) == 1) else 1.0 for f in range(n)]
        write_deck(root, "m1", "0_1-11", permx, {"P1": vertical(5, 5), "INJ1": vertical(35, 5)}, [("P1", 0, 10)])
        write_deck(root, "m2", "2_1-12", [1.0] * n, {"P1": vertical(5, 5)}, [])
        write_deck(root, "m3", "1_centroid", permx, {"P1": vertical(5, 5)}, [])
        (root / "m3" / "INCLUDE" / "1_centroid_PERMX.inc").write_text("PERMX\n1 2 3 /\n")  # a broken cube: the deck is left out
        (root / "empty").mkdir()
        out[e] = str(root)
    return out


def test_descriptors_and_connectivity_of_decks(spark, roots, tmp_path):
    e = experiment.Experiment(spark, roots[1], 1, f"{tmp_path}/work", cutoff=100.0)
    assert [(r.deck_name, r.cluster, r.seed, r.centroid) for r in e.decks.orderBy("model").collect()] == [
        ("0_1-11.data", 0, 11, False), ("2_1-12.data", 2, 12, False), ("1_centroid.data", 1, None, True)
    ]
    assert len(e.grid["faults"]) == 1 and e.layers().count() == NX * NY * NZ and e.pillars().count() == (NX + 1) * (NY + 1)
    d = {(r.seed, r.well): r for r in e.descriptors(0.5).collect()}
    assert set(d) == {(11, "P1"), (11, "INJ1"), (12, "P1")}
    p = d[11, "P1"]
    # two of three layers are perforated, and each run lies between its first and last sample
    assert (
        p.n_cells_traversed, p.n_cells_perforated, p.n_sand_cells, p.frac_channel_cells, p.mean_ntg_along_well, p.perm_cutoff_mD
    ) == (3, 2, 3, 1.0, 1.0, 100.0)
    assert p.kh_penetrated == pytest.approx(500 * p.net_sand_penetrated) and 9 <= p.net_sand_penetrated <= 10
    assert (d[12, "P1"].n_sand_cells, d[12, "P1"].n_cells_perforated) == (0, 3)
    c = {r.seed: r for r in e.connectivity(0.5).collect()}
    assert (
        c[11].n_bodies_26, c[11].n_bodies_6, c[11].frac_sand_in_largest_26, c[11].n_producers, c[11].n_injectors,
        c[11].n_producers_connected_to_any_inj
    ) == (2, 2, 0.5, 1, 1, 0)
    assert (c[12].n_bodies_26, c[12].top1_n_cells, c[12].n_producers, c[12].mean_inj_connections_per_producer) == (0, 0, 1, 0)


def test_geology_command(spark, roots, tmp_path, capsys):
    assert cli.main(["geology", "--out", str(tmp_path), "--cutoff", "100", *(f"{n}={r}" for n, r in roots.items())]) == 0
    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}")
    assert "comparison" in capsys.readouterr().out
    c = {(r.experiment, r.seed): r for r in read("connectivity").collect()}
    assert c[2, 11].n_bodies_26 == 1 and c[2, 11].max_inj_connections_per_producer == 1
    diff = {r.seed: r for r in read("cube_difference").collect()}
    assert set(diff) == {11, 12} and diff[11].delta_permx > 0 == diff[12].delta_permx
    assert read("comparison").where("metric = 'mean_inj_connections_per_producer' and value_new > value_old").count() == 1
    i = read("index")
    assert i.where("has_permx = 1").count() == 6 and i.where("has_results = 1").count() == 0 and i.where("has_tracks = 1").count() >= 5


def test_geology_command_with_history_and_production(spark, roots, tmp_path):
    """All axes: history by cluster and against connectivity, and what geology adds to the parameters."""
    r = np.random.default_rng(1)
    setups = [(s, m, m % 2, float(r.uniform(0, 9)) / f, float(r.uniform(0, 20)) / f, float(r.uniform(0, 40)) / f) for f, s in ((1, "a"), (3, "b")) for m in range(12)]
    spark.createDataFrame(setups, "setup string, model_id long, cluster_id long, dev_field_cum_pct double, dev_field_annual_max_pct double, dev_well_top80_max_pct double").write.parquet(f"{tmp_path}/history")
    spark.createDataFrame([(m, 11 + m % 2) for m in range(12)], "model_id long, seed long").write.parquet(f"{tmp_path}/seeds")
    rows = [(11 + i % 2, i % 2, float(r.normal()), float(r.normal()) + 5 * (i % 2)) for i in range(40)]
    spark.createDataFrame(rows, "seed long, cluster long, p_a double, r_oil double").write.parquet(f"{tmp_path}/rows")
    args = ["--history", f"{tmp_path}/history", "--seeds", f"{tmp_path}/seeds", "--production", f"{tmp_path}/rows", "--draws", "20"]
    assert cli.main(["geology", "--out", f"{tmp_path}/out", "--cutoff", "100", *args, *(f"{n}={x}" for n, x in roots.items())]) == 0
    found = {}
    for x in spark.read.parquet(f"{tmp_path}/out/comparison").collect():
        found.setdefault(x.axis, {})[x.metric, x.scope] = x
    assert set(found) == {"rebuild", "connectivity", "descriptors", "diversity", "history", "production"}
    assert found["history"]["mean_total_misfit", "cluster_0"].status == "BETTER" and found["rebuild"]["frac_netflag_changed", "matched_seeds"].value_old == 0
    assert found["history"]["share_pass_all_three", "all"].value_new >= found["history"]["share_pass_all_three", "all"].value_old
    up = found["production"]["r2_r_oil", "all"]
    assert up.value_new > up.value_old + 0.5 and up.status == "BETTER"
    assert any(m.startswith("corr_misfit_") for m, _ in found["history"]) and any(m.startswith("width_") for m, _ in found["diversity"])
    assert spark.read.parquet(f"{tmp_path}/out/uplift").count() == 3


def test_no_decks(spark, tmp_path):
    e = experiment.Experiment(spark, str(tmp_path), 1, f"{tmp_path}/work")
    assert e.decks.count() == 0 and e.grid is None
    with pytest.raises(ValueError):
        experiment.geology_tables(spark, {1: str(tmp_path)}, f"{tmp_path}/out")


def _rows(spark, n=60):
    r = np.random.default_rng(3)
    x = r.normal(size=(n, 3))
    y = x @ [1.0, 0.5, 0.0] + 0.3 * r.normal(size=n)
    z = -x[:, 2] + 0.1 * r.normal(size=n)
    return x, y, z, spark.createDataFrame(
        [(i, i % 3, *map(float, x[i]), float(y[i]), None if i == 5 else float(z[i])) for i in range(n)],
        "member_id long, cluster long, a double, g1 double, g2 double, oil double, cut double"
    )


def _r2(x, y):
    x = np.column_stack([np.ones(len(y)), x])
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    return 1 - (e**2).sum() / ((y - y.mean()) ** 2).sum()


def test_production_link_by_dense_formulas(spark):
    x, y, z, rows = _rows(spark)
    out = production.production_link(rows, ["a"], ["g1", "g2"], ["oil", "cut"], draws=50)
    up = {(r.response, r.scope): r for r in out["uplift"].collect()}
    assert set(up) == {(a, s) for a in ("oil", "cut") for s in ("all", "cluster_0", "cluster_1", "cluster_2")}
    r = up["oil", "all"]
    assert (r.n, r.status) == (60, "OK") and r.r2_base == pytest.approx(_r2(x[:, :1], y)) and r.r2_full == pytest.approx(_r2(x, y)) and r.uplift == pytest.approx(
        r.r2_full - r.r2_base
    )
    assert r.ci_low <= r.uplift <= r.ci_high and r.r2_full_cv < r.r2_full
    one = np.arange(60) % 3 == 2
    assert up["oil", "cluster_2"].r2_full == pytest.approx(_r2(x[one], y[one]))
    keep = np.arange(60) != 5
    assert up["cut", "all"].n == 59 and up["cut", "all"].r2_full == pytest.approx(_r2(x[keep], z[keep]))
    s = {(r.response, r.predictor): r for r in out["src2"].collect()}
    xs = (x - x.mean(0)) / x.std(0)
    b = np.linalg.lstsq(xs, y - y.mean(), rcond=None)[0] / y.std(ddof=1)
    assert [s["oil", c].src2 for c in ("a", "g1", "g2")] == pytest.approx(b**2) and s["oil", "a"].stability_fraction == 1.0
    corr = {(r.predictor, r.response): r for r in out["correlations"].collect()}
    assert corr["g2", "cut"].r == pytest.approx(np.corrcoef(x[keep, 2], z[keep])[0, 1]) and corr["g2", "cut"].significant
    few = production.production_link(rows.limit(6), ["a"], ["g1", "g2"], ["oil"], draws=5)
    assert {r.status for r in few["uplift"].collect()} == {"TOO_FEW_SAMPLES"} and few["src2"].count() == 0


def _study(spark, n=30, p=14, k=3):
    r = np.random.default_rng(8)
    z, h = r.normal(size=(n, k)), r.normal(size=(k, p))
    d = 20 * (z @ h) + r.normal(size=(n, p))
    theta = spark.createDataFrame(
        [(i, i % 2, f"c{j}", j, float(z[i, j])) for i in range(n) for j in range(k)],
        "member_id long, cluster_id long, comp string, comp_pos int, value double"
    )
    sim = spark.createDataFrame(
        [(i, i % 2, "m", "W", t, float(d[i, t])) for i in range(n) for t in range(p)],
        "member_id long, cluster_id long, metric string, well string, time long, value double"
    )
    return z, d, theta, sim


def test_singular_values_by_blocks(spark, monkeypatch):
    _, d, _, sim = _study(spark)
    blocks = linear.position_blocks
    monkeypatch.setattr(linear, "position_blocks", lambda *a, **k: blocks(*a, **{"block": 4} | k))
    want = np.linalg.svd((d - d.mean(0)) / np.sqrt(len(d) - 1), compute_uv=False)
    got = linear.singular_values(sim, 0.9).orderBy("k").collect()
    assert [r.s for r in got] == pytest.approx(want, rel=1e-6) and [r.kept for r in got].count(True) == len(linear.truncated_svd(d - d.mean(0), 0.9)[1])


@pytest.mark.parametrize(("energy", "localized"), [(1.0, False), (0.95, False), (0.99, True)])
def test_update_by_dense_formulas(spark, monkeypatch, energy, localized):
    z, d, theta, sim = _study(spark)
    blocks = linear.position_blocks
    monkeypatch.setattr(linear, "position_blocks", lambda *a, **k: blocks(*a, **{"block": 4} | k))
    truth = spark.createDataFrame(
        [("m", "W", t, 3.0 * t, 1.0 + t) for t in range(d.shape[1])], "metric string, well string, time long, d_obs double, sigma double"
    )
    sigma, obs = 1.0 + np.arange(d.shape[1]), 3.0 * np.arange(d.shape[1])
    mask = None
    m = np.ones((z.shape[1], d.shape[1]))
    if localized:
        m = (np.add.outer(np.arange(z.shape[1]), np.arange(d.shape[1])) % 3) / 2
        mask = spark.createDataFrame(
            [(f"c{j}", "m", "W", t, float(m[j, t])) for j in range(z.shape[1]) for t in range(d.shape[1])],
            "comp string, metric string, well string, time long, mask double"
        )
    eps = linear.perturbation_table(theta, truth, 9).toPandas().assign(
        t=lambda x: x.pos.str.split("|").str[2].astype(int)
    ).pivot(index="member_id", columns="t", values="eps").to_numpy()
    gain, _, _ = linear.gain_matrix(z, d, sigma, energy, m)
    want = z + (obs + eps - d) @ gain.T
    got = linear.ensemble_update(theta, sim, truth, mask, energy, seed=9).toPandas().pivot(index="member_id", columns="comp", values="value").to_numpy()
    assert got == pytest.approx(want, rel=1e-5, abs=1e-6)
    assert abs(eps / sigma).mean() == pytest.approx(np.sqrt(2 / np.pi), abs=0.08)


def test_validation_of_all_components(spark):
    z, d, theta, sim = _study(spark)
    split = members.stratified_split(theta.select("member_id", "cluster_id").distinct(), 0.3, 1)
    val = {r.member_id for r in split.where("split = 'val'").collect()}
    errors = []
    for c in (0, 1):
        train, held = ([i for i in range(len(z)) if i % 2 == c and (i in val) == w] for w in (False, True))
        zc, dc = z[train] - z[train].mean(0), d[train] - d[train].mean(0)
        s = np.linalg.pinv(zc.T @ zc / (len(train) - 1) + 1e-8 * np.eye(z.shape[1])) @ (zc.T @ dc / (len(train) - 1))
        dev = d[train].std(0, ddof=1)
        errors += [np.median(np.abs(d[train].mean(0) + (z[i] - z[train].mean(0)) @ s - d[i]) / np.where(dev > 1, dev, 1)) for i in held]
    out = {r.cluster_id: r for r in linear.validate_proxy(theta, sim, split).collect()}
    assert set(out) == {-1, 0, 1} and out[-1].n_val == len(val)
    assert (out[-1].median_rel_err, out[-1].mean_rel_err, out[-1].max_rel_err) == pytest.approx((np.median(errors), np.mean(errors), np.max(errors)))
    assert out[-1].verdict == "PASS"
    assert linear.proxy_errors(theta, sim, split.withColumn("split", F.lit("train"))).count() == 0


def test_tall_factorisation_keeps_small_values(spark):
    """Singular values of a matrix of condition 1e10 to 1e-10 of the largest, by members and by positions, and of 100,000 members."""
    r = np.random.default_rng(8)
    q = np.linalg.qr(r.normal(size=(300, 7)) - r.normal(size=(1, 7)))[0]
    q = np.linalg.qr(q - q.mean(0))[0]
    want = np.logspace(0, -10, 7)
    d = (q * want) @ np.linalg.qr(r.normal(size=(7, 7)))[0].T * np.sqrt(299)
    rows = [(i, "cum", "oil", f"W{j}", 2000, float(d[i, j])) for i in range(300) for j in range(7)]
    sim = spark.createDataFrame(rows, "member_id LONG, kind STRING, metric STRING, well STRING, time LONG, value DOUBLE")
    true = np.linalg.svd((d - d.mean(0)) / np.sqrt(299), compute_uv=False)
    positions, s, vt = linear.by_members(sim)
    assert positions == sorted(positions) and np.abs(s - true).max() < 1e-13 and np.abs(s - want).max() < 1e-10
    blocks, names, n = linear.member_blocks(sim, block=40)
    held, n = linear._numbered(blocks, n)
    assert n > linear.MERGE - 1 and len(names) == 7
    again = np.linalg.svd(linear.triangular(held, lambda pdf: np.stack(pdf["values"].to_numpy()), n), compute_uv=False)
    assert np.abs(again - true).max() < 1e-13
    wide = spark.createDataFrame([(j, "cum", "oil", f"W{i}", 2000, float(d[i, j])) for i in range(300) for j in range(7)], sim.schema)
    got = [x.s for x in linear.singular_values(wide, 1.0).orderBy("k").collect()]
    dw = d.T - d.T.mean(0)
    assert np.abs(np.array(got) - np.linalg.svd(dw / np.sqrt(6), compute_uv=False)[:7]).max() < 1e-13
    many = spark.range(100_000).select(F.col("id").alias("member_id"), F.explode(F.array(*(F.lit(w) for w in "abc"))).alias("well")).select(
        "member_id", F.lit("cum").alias("kind"), F.lit("oil").alias("metric"), "well", F.lit(2000).cast("long").alias("time"), F.xxhash64("member_id", "well").cast("double").alias("value")
    )
    s = [x.s for x in linear.singular_values(many, 1.0).orderBy("k").collect()]
    x = many.groupBy("member_id").pivot("well").agg(F.first("value")).drop("member_id").toPandas().to_numpy()
    assert s == pytest.approx(np.linalg.svd((x - x.mean(0)) / np.sqrt(len(x) - 1), compute_uv=False).tolist(), rel=1e-10)
