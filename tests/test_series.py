import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import series

COLS = "member_id BIGINT, cluster_id BIGINT, kind STRING, metric STRING, well STRING, time BIGINT, value DOUBLE"


def sim(spark, rows, kind="rate"):
    return spark.createDataFrame([(m, 0, kind, "oil", w, t, float(v)) for m, w, t, v in rows], COLS)


def truth(spark, rows):
    return spark.createDataFrame([("rate", "oil", w, t, float(v)) for w, t, v in rows], "kind STRING, metric STRING, well STRING, time BIGINT, d_obs DOUBLE")


def test_field_total(spark):
    d = [[1, 2], [3, 4], [5, 6]]
    row = series.field_total_quantiles(sim(spark, [(m, w, 1, v) for m, r in enumerate(d) for w, v in zip("AB", r, strict=True)])).first()
    assert row.p50 == 7 and row.mean == 7 and row.std == 4 and row.p10 <= row.p50 <= row.p90


@pytest.mark.parametrize(("y", "want"), [(7, 0), (7.5, 0.5), (6, 1), (10, 3)])
def test_crps_of_a_point_mass(spark, y, want):
    got = series.crps(sim(spark, [(m, "A", 1, 7) for m in range(5)]), truth(spark, [("A", 1, y)])).first().crps
    assert got == pytest.approx(want)


@pytest.mark.parametrize("w", [1.0, 5.0, 100.0])
def test_crps_of_a_uniform(spark, w):
    n = 5000
    rows = spark.range(n).select(
        F.col("id").alias("member_id"), F.lit("oil").alias("metric"), F.lit("A").alias("well"), F.lit(1).cast("long").alias("time"),
        ((F.col("id") + 0.5) * w / n).alias("value")
    )
    assert series.crps(rows, truth(spark, [("A", 1, w / 2)])).first().crps == pytest.approx(w / 12, rel=0.02)


def test_width_ratio_guards_zero(spark):
    a = sim(spark, [(m, "A", 1, m) for m in range(5)])
    flat = sim(spark, [(m, "A", 1, 1) for m in range(5)])
    assert series.width_ratio(a, a).first().width_ratio == 1
    assert series.width_ratio(a.withColumn("value", F.col("value") * 2), a).first().width_ratio == pytest.approx(2)
    assert series.width_ratio(flat, flat).first().width_ratio == 0
    assert series.median_shift(a.withColumn("value", F.col("value") + 3), a).first().median_shift == 3


def test_coverage_is_closed(spark):
    s = sim(spark, [(m, w, 1, m) for m in range(11) for w in "AB"])
    assert series.coverage(s, truth(spark, [("A", 1, 1), ("B", 1, 20)])).first().coverage == 0.5


def test_misfit(spark):
    m = series.misfit(sim(spark, [(0, "A", 1, 49), (1, "A", 1, 51)]), truth(spark, [("A", 1, 0)])).first()
    assert m.residual == 50 and m.residual_z > 10
    assert series.misfit(sim(spark, [(0, "A", 1, 4)]), truth(spark, [("A", 1, 1)])).first().d_sim_std == 1


def test_trapezoid_runs_across_wells(spark):
    t = truth(spark, [("A", 1, 1), ("A", 2, 3), ("B", 1, 5)])
    assert series.trapezoid(t, ["metric"], ["well", "time"], "d_obs").first().integral == 6


def test_sigma_floor(spark):
    s = series.diag_sigma(truth(spark, [("A", 1, 0), ("A", 2, 1e8), ("A", 3, 2e8)])).orderBy("time").collect()
    assert [r.sigma for r in s] == [1e6, 1.5e7, 3e7]
    assert series.diag_sigma(truth(spark, [("A", 1, 0)]), zero_metrics=("oil",)).first().sigma == 1e6


def test_split(spark):
    s = sim(spark, [(0, "A", t, 1) for t in range(2011, 2019)])
    out = series.split_history(s, 6, 2)
    assert out.groupBy("split").count().orderBy("split").collect()[0]["count"] == 6
    for bad in ((0, 1), (1, 0), (8, 1)):
        with pytest.raises(ValueError):
            series.split_history(s, *bad)


def test_forecast_anomaly_without_history(spark):
    out = series.forecast_anomaly(sim(spark, [(0, "A", 1, 5), (0, "A", 3, 9), (1, "A", 3, 4)], "cum"), 2)
    assert sorted(r.value for r in out.collect()) == [4, 4]


def test_quantiles_match_numpy(spark):
    v = np.random.default_rng(0).normal(size=37)
    r = series.column_quantiles(sim(spark, [(m, "A", 1, x) for m, x in enumerate(v)])).first()
    assert [r.p10, r.p50, r.p90] == pytest.approx(np.quantile(v, [0.1, 0.5, 0.9]).tolist())
