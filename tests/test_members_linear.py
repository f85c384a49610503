import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import linear, members, series

THETA = "member_id BIGINT, cluster_id BIGINT, model_id BIGINT, comp STRING, comp_pos INT, value DOUBLE"


def theta(spark, z, clusters=None, models=None):
    n, k = z.shape
    return spark.createDataFrame(
        [
            (
                i, int(clusters[i]) if clusters is not None else 0, int(models[i]) if models is not None else i, f"p{j}", j, float(z[i, j])
            ) for i in range(n) for j in range(k)
        ],
        THETA
    )


def data(spark, d, clusters=None):
    return spark.createDataFrame(
        [
            (
                i, int(clusters[i]) if clusters is not None else 0, "rate", "oil", "A", j, float(d[i, j])
            ) for i in range(d.shape[0]) for j in range(d.shape[1])
        ],
        "member_id BIGINT, cluster_id BIGINT, kind STRING, metric STRING, well STRING, time BIGINT, value DOUBLE"
    )


def observed(spark, y, sigma):
    return spark.createDataFrame(
        [("oil", "A", j, float(v), float(s)) for j, (v, s) in enumerate(zip(y, sigma, strict=True))],
        "metric STRING, well STRING, time BIGINT, d_obs DOUBLE, sigma DOUBLE"
    )


@pytest.fixture(scope="module")
def problem():
    r = np.random.default_rng(7)
    z, h, t = r.normal(0, 1.5, (60, 3)), r.normal(size=(3, 8)), r.normal(size=3)
    return z, z @ h, t, t @ h, np.full(8, 0.2)


def test_update_matches_the_dense_formula(spark, problem):
    z, d, _, y, s = problem
    got = linear.ensemble_update(
        theta(spark, z), data(spark, d), observed(spark, y, s), energy=1.0, perturb=False
    ).toPandas().pivot(index="member_id", columns="comp", values="value").to_numpy()
    zc, dc = z - z.mean(0), d - d.mean(0)
    k, _, r = linear.gain_matrix(z, d, s, 1.0)
    e = dc.T @ dc / (len(z) - 1)
    v = np.linalg.svd(dc, full_matrices=False)[2][:r]
    want = zc.T @ dc / (len(z) - 1) @ v.T @ np.linalg.inv(v @ (e + np.diag(s**2)) @ v.T) @ v
    assert np.allclose(k, want, atol=1e-6)
    assert np.allclose(got, z + (y - d) @ k.T)


def test_update_nears_the_truth_and_shrinks(spark, problem):
    z, d, t, y, s = problem
    post = linear.ensemble_update(
        theta(spark, z), data(spark, d), observed(spark, y, s)
    ).toPandas().pivot(index="member_id", columns="comp", values="value").to_numpy()
    assert np.all(np.abs(post.mean(0) - t) < z.std(0))
    assert np.all(post.std(0) < z.std(0))


def test_masked_gain_changes_nothing(spark, problem):
    z, d, _, y, s = problem
    mask = linear.localization(linear.correlation(theta(spark, z), data(spark, d)), 1e6)
    post = linear.ensemble_update(theta(spark, z), data(spark, d), observed(spark, y, s), mask)
    assert post.join(theta(spark, z).withColumnRenamed("value", "v0"), ["member_id", "comp"]).where(F.abs(F.col("value") - F.col("v0")) > 1e-12).count() == 0


def test_svd_and_rank():
    a = np.outer([1.0, 2, 3], [1.0, 0, 1])
    assert len(linear.truncated_svd(a)[1]) == 1 and linear.matrix_rank(a) == 1
    assert len(linear.truncated_svd(np.zeros((3, 2)))[1]) == 0
    with pytest.raises(ValueError):
        linear.gain_matrix(np.zeros((3, 2)), np.zeros((2, 2)), np.zeros(2))


def test_perturbations_repeat():
    a, b = (linear.perturbations(np.ones(3), 5, 1) for _ in range(2))
    assert np.array_equal(a, b)
    assert linear.perturbations(np.ones(2), 4000, 1, np.array([[1, 0.9], [0.9, 1]])).T @ linear.perturbations(
        np.ones(2), 4000, 1, np.array([[1, 0.9], [0.9, 1]])
    ) / 4000 == pytest.approx(np.array([[1, 0.9], [0.9, 1]]), abs=0.1)


def test_correlation_of_a_constant_is_zero(spark):
    z = np.column_stack([np.arange(5.0), np.ones(5)])
    got = {r.comp: r.r for r in linear.correlation(theta(spark, z), data(spark, np.arange(5.0)[:, None])).collect()}
    assert got["p0"] == pytest.approx(1) and got["p1"] == 0
    t = linear.localization(linear.correlation(theta(spark, z), data(spark, np.arange(5.0)[:, None])), 3.0).first()
    assert t.threshold == pytest.approx(3 / np.sqrt(5))
    with pytest.raises(ValueError):
        linear.localization(linear.correlation(theta(spark, z), data(spark, np.arange(5.0)[:, None])), 3.0, "other")


def test_mahalanobis_and_plan(spark, problem):
    z = problem[0]
    prior, post = theta(spark, z), theta(spark, z + np.arange(60)[:, None] * 0.01)
    same = linear.mahalanobis(prior, prior).agg(F.max("distance")).first()[0]
    assert same == pytest.approx(0)
    d = linear.mahalanobis(prior, post).withColumn("ord", F.col("member_id")).withColumn("cluster_id", F.col("member_id") % 3)
    c = np.linalg.inv(np.cov(z.T))
    want = 0.59 * np.sqrt(np.ones(3) @ c @ np.ones(3))
    assert d.where("member_id = 59").first().distance == pytest.approx(want)
    plan = members.plan_resimulation(members.rank_members(d), 5, 6, 1)
    got = plan.toPandas()
    assert sorted(got["rank"]) == list(range(1, 61)) and got[got["rank"] == 1].member_id.item() == 59
    assert (got.role == "resimulate").sum() == 5 and got.validate.sum() == 6 and not got[got.validate].role.eq("resimulate").any()
    assert got[got.validate].cluster_id.nunique() == 3
    with pytest.raises(ValueError):
        members.plan_resimulation(d, 1, 1, 1)


def test_proxy_recovers_a_linear_map(spark, problem):
    z, d, *_ = problem
    c = np.array([0] * 30 + [1] * 29 + [2])
    p = linear.build_proxies(theta(spark, z, c), data(spark, d, c))
    assert {r.cluster_id for r in p.select("cluster_id").distinct().collect()} == {0, 1}
    out = linear.predict(p, theta(spark, z, c)).toPandas()
    alone = out[out.member_id == 59]
    assert len(alone) == 1 and alone.predicted.isna().all() and not alone.in_envelope.any()
    rest = out[out.member_id < 59]
    assert rest.in_envelope.all()
    got = rest.assign(t=rest.pos.str.split("|").str[2].astype(int)).pivot(index="member_id", columns="t", values="predicted").to_numpy()
    assert np.allclose(got, d[:59], atol=1e-4)


def test_dedup_and_duplicates(spark):
    ids = [10, 20, 10]
    m = spark.createDataFrame(
        [(i, ids[i], [0, 1, 2][i], i, i) for i in range(3)], "member_id BIGINT, model_id BIGINT, cluster_id BIGINT, seed BIGINT, ord BIGINT"
    )
    prior, post = theta(spark, np.zeros((3, 2))), theta(spark, np.array([[3.0, 4], [9, 9.5], [5, 6]]))
    got = members.deduplicate(m, prior, post).orderBy("first_ord", "comp").collect()
    assert [r.theta_post for r in got[:2]] == [4, 5] and got[0].n_collapsed == 1 and got[0].cluster_id == 0
    d = members.duplicate_models(m, prior, post).collect()
    assert len(d) == 1 and d[0].model_id == 10 and d[0].clusters == "0,2" and d[0].distance == pytest.approx(np.sqrt(8))


def test_spread_and_messages(spark, problem):
    z = problem[0]
    post = z.copy()
    post[:, 0] *= 0.05
    prior, after = theta(spark, z), theta(spark, post)
    s = members.spread_retention(prior, after)
    assert s.where("collapsed").count() == 1
    m = spark.createDataFrame([(i, i, 0, i, i) for i in range(60)], "member_id BIGINT, model_id BIGINT, cluster_id BIGINT, seed BIGINT, ord BIGINT")
    msgs = members.messages(s, members.physical_bounds(prior, after), members.duplicate_models(m, prior, after), 3, 60, 3)
    assert not members.passed(msgs).first().passed
    ok = members.messages(members.spread_retention(prior, prior), members.physical_bounds(prior, prior), members.duplicate_models(m, prior, prior), 3, 60, 3)
    assert ok.count() == 0 and members.passed(ok).first().passed


def test_clip_and_pack(spark):
    prior, post = theta(spark, np.array([[0.0, 1], [2, 3]])), theta(spark, np.array([[-1.0, 2], [9, 2]]))
    got = {(r.member_id, r.comp): (r.value, r.clipped) for r in members.clip_to_prior(post, prior).collect()}
    assert got[0, "p0"] == (0, True) and got[1, "p0"] == (2, True) and got[0, "p1"] == (2, False)
    packed = members.pack(members.state_vector(prior))
    assert members.unpack(packed, {"theta": (0, 2)}, 2).count() == 4
    with pytest.raises(Exception, match="wide"):
        members.unpack(packed, {"theta": (0, 2)}, 3).collect()


def test_bimodality(spark):
    two = spark.createDataFrame([("a", float(x)) for x in [-1, 1] * 20] + [("b", 1.0)] * 5 + [("c", 1.0), ("c", 2.0)], "comp STRING, value DOUBLE")
    got = {r.comp: r.bimodality for r in members.bimodality(two, ["comp"]).collect()}
    assert got["a"] > 0.555 and got["b"] == 0 and got["c"] == 0


def test_cross_validation_can_be_negative(spark):
    r = np.random.default_rng(3)
    rows = spark.createDataFrame([("g", i, float(a), float(b)) for i, (a, b) in enumerate(r.normal(size=(30, 2)))], "g STRING, i BIGINT, x DOUBLE, y DOUBLE")
    assert linear.cross_validated_r2(rows, ["g"], "i", "x", "y").first().r2_cv < 0.1
    assert linear.cross_validated_r2(rows.where("i < 9"), ["g"], "i", "x", "y").count() == 0


def test_regressions_in_tasks(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(40, 3))
    y = x @ [2.0, 1.0, 0.0] + r.normal(0, 0.1, 40)
    rows = spark.createDataFrame([("all", *map(float, v), float(t)) for v, t in zip(x, y, strict=True)], "g STRING, a DOUBLE, b DOUBLE, c DOUBLE, y DOUBLE")
    u = linear.r2_uplift(rows, "g", ["a"], ["b", "c"], "y", draws=100).first()
    assert 0.1 < u.uplift < 0.3 and u.ci_low < u.uplift < u.ci_high and u.r2_full_cv > 0.95
    s = {q.predictor: q for q in linear.src2(rows, "g", ["a", "b", "c"], "y", draws=100).collect()}
    assert s["a"].src2 > s["b"].src2 > s["c"].src2 and s["a"].stability_fraction == 1
    assert linear.r2_uplift(rows.limit(5), "g", ["a"], ["b", "c"], "y", draws=10).first().n == 5


def test_metric_summary_is_mean_of_means(spark):
    t = spark.createDataFrame(
        [("oil", 1, 1.0, 0.0, 0.0), ("oil", 2, 3.0, 0.0, 1.0)],
        "metric STRING, time BIGINT, width_ratio DOUBLE, median_shift DOUBLE, crps DOUBLE"
    )
    assert series.metric_summary(t).first().mean_width_ratio == 2
