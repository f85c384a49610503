import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell import __main__ as cli
from tidewell.plans import phases
from tidewell.schemas import assert_schema, nan_to_null, violations


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    """A linear Gaussian study: 20 members in three clusters, 5 parameters, 10 observations, 10 forecasts."""
    d = str(tmp_path_factory.mktemp("study"))
    r = np.random.default_rng(42)
    n = 20
    clusters = [0] * 7 + [1] * 7 + [2] * 6
    truth, z = r.normal(0, 2.0, 5), r.normal(0, 1.5, (n, 5))
    h, g = r.normal(0, 0.5, (10, 5)), r.normal(0, 0.5, (10, 5))
    y = h @ truth + r.normal(0, 1.0, 10)
    key = lambda j, y0: ("oil", f"W{j % 2 + 1}", y0 + j // 2)
    spark.createDataFrame(
        [(i, 100 + i, clusters[i], i, i) for i in range(n)], "member_id BIGINT, model_id BIGINT, cluster_id BIGINT, seed BIGINT, ord BIGINT"
    ).write.parquet(f"{d}/members")
    spark.createDataFrame(
        [(i, clusters[i], 100 + i, f"p{j}", j, float(z[i, j])) for i in range(n) for j in range(5)],
        "member_id BIGINT, cluster_id BIGINT, model_id BIGINT, comp STRING, comp_pos INT, value DOUBLE"
    ).write.parquet(f"{d}/theta")
    s = "member_id BIGINT, cluster_id BIGINT, kind STRING, metric STRING, well STRING, time BIGINT, value DOUBLE"
    spark.createDataFrame([(i, clusters[i], "cum", *key(j, 2011), float((h @ z[i])[j])) for i in range(n) for j in range(10)], s).write.parquet(f"{d}/sim")
    spark.createDataFrame([(i, clusters[i], "cum", *key(j, 2025), float((g @ z[i])[j])) for i in range(n) for j in range(10)], s).write.parquet(f"{d}/forecast")
    o = "kind STRING, metric STRING, well STRING, time BIGINT, d_obs DOUBLE, sigma DOUBLE"
    spark.createDataFrame([("cum", *key(j, 2011), float(y[j]), 1.0) for j in range(10)], o).write.parquet(f"{d}/observed")
    spark.createDataFrame([("cum", *key(j, 2025), float((g @ truth)[j]), 1.0) for j in range(10)], o).write.parquet(f"{d}/truth")
    return d


@pytest.mark.parametrize(
    "cfg",
    [
        phases.Config(factor=1.0, top_x=5, validation_n=3, keep_outside=True),
        phases.Config(
            factor=1.0, hindcast=True, train_years=3, val_years=2, top_x=5, validation_n=3, keep_outside=True, clip_to_prior=True,
            dedup=True
        )
    ]
)
def test_all_phases(spark, study, tmp_path, cfg):
    out = str(tmp_path)
    tables = phases.run(spark, study, out, "all", cfg)
    s = tables["summary"].collect()
    assert {(r.setup, r.evaluation_mode) for r in s} == {(f"setup{i}", "hindcast" if cfg.hindcast else "forecast") for i in (1, 2, 3)}
    by = {r.setup: r for r in s}
    assert by["setup1"].mean_width_ratio == pytest.approx(1) and by["setup2"].mean_crps == pytest.approx(by["setup3"].mean_crps)
    post = spark.read.parquet(f"{out}/phase1/theta_post")
    assert post.count() == 100 and post.where("value is null").count() == 0
    prior = spark.read.parquet(f"{study}/theta").groupBy("comp").agg(F.stddev_samp("value").alias("a"))
    assert post.groupBy("comp").agg(F.stddev_samp("value").alias("b")).join(prior, "comp").where("b < a").count() >= 3
    # a fifth of each cluster's members are held out, whatever their number
    v = {r.cluster_id: r for r in spark.read.parquet(f"{out}/phase2/proxy_validation").collect()}
    assert set(v) == {-1, 0, 1, 2} and v[-1].n_val == sum(v[c].n_val for c in (0, 1, 2)) == 3 and {r.verdict for r in v.values()} <= {"PASS", "WARN", "FAIL"}
    assert spark.read.parquet(f"{out}/phase2/proxy_errors").count() == 3 and "phase2/proxy_validation" in phases.report(spark, out)
    if not cfg.hindcast:
        page = phases.report(spark, out)
        assert all(f"<h2>{n}</h2>" in page for n in ("phase3/setup2_metrics", "phase2/plan/resimulate", "phase1/qc/migration"))
        both = phases.compare_phase1(spark, {"one": out, "two": out})
        assert both["spread"].count() == 5 and both["centroids"].count() == 15


def test_bad_study(spark, study, tmp_path):
    t = spark.read.parquet(f"{study}/theta")
    for n in ("members", "sim", "observed"):
        spark.read.parquet(f"{study}/{n}").write.parquet(f"{tmp_path}/in/{n}")
    t.withColumn("value", F.when(F.col("member_id") == 3, float("nan")).otherwise(F.col("value"))).write.parquet(f"{tmp_path}/in/theta")
    with pytest.raises(ValueError):
        phases.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", "0")


def test_command_line():
    with pytest.raises(SystemExit):
        cli.main(["run", "--phase", "9"])


def test_schemas(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, 2.0)], "a INT, v DOUBLE")
    assert nan_to_null(df).where("v is null").count() == 1
    assert violations(df, ["a"], ["v"]).first().asDict() == {"null_keys": 0, "bad_values": 1, "repeated_keys": 1}
    assert assert_schema(df, "v DOUBLE, a BIGINT").dtypes == [("v", "double"), ("a", "bigint")]
    with pytest.raises(ValueError):
        assert_schema(df, "b INT")
    with pytest.raises(ValueError):
        assert_schema(df, "v STRING")


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from tidewell.streaming import rates

    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.repartitionByRange(3, "ts").write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    q = rates.windowed_moments(
        stream, width="7 days", late="60 days"
    ).writeStream.outputMode("update").format("memory").queryName("moments").option(
        "checkpointLocation", f"{tmp_path}/cp"
    ).start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("moments").groupBy("start", "event_type").agg(F.max("n").alias("n"))
    want = rates.windowed_moments(batch, width="7 days")
    assert sorted((r.start, r.event_type, r.n) for r in last.collect()) == sorted((r.start, r.event_type, r.n) for r in want.collect())
    e = spark.createDataFrame([("click", 10.0)], "event_type STRING, expected DOUBLE")
    assert rates.windowed_misfit(batch, e).where("event_type <> 'click'").count() == 0
