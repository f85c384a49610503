"""Statistics over members of simulated series.

Series are long: member_id, cluster_id, kind, metric, well, time, value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


KEY = ["metric", "well", "time"]


def column_quantiles(sim: DataFrame, quantiles=(0.1, 0.5, 0.9), keys=KEY, weight: str | None = None) -> DataFrame:
    """Linear-interpolation quantiles over members for each key, as p10, p50, ...; nulls are skipped. A row counts `weight` times if that column is named."""
    q = F.percentile("value", F.array(*(F.lit(float(x)) for x in quantiles)), *([F.col(weight)] if weight else []))
    out = sim.groupBy(*keys).agg(q.alias("q"))
    return out.select(*keys, *(F.element_at("q", i + 1).alias(f"p{round(100 * x)}") for i, x in enumerate(quantiles)))


def _moments(sim: DataFrame, keys) -> DataFrame:
    q = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = sim.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), q.alias("q"))
    return out.select(*keys, "mean", "std", *(F.element_at("q", i + 1).alias(p) for i, p in enumerate(("p10", "p50", "p90"))))


def field_total_quantiles(sim: DataFrame) -> DataFrame:
    """Sum over wells for each member first, then mean, std and quantiles for each (metric, time)."""
    return _moments(sim.groupBy("member_id", "metric", "time").agg(F.sum("value").alias("value")), ["metric", "time"])


def per_well_quantiles(sim: DataFrame) -> DataFrame:
    return _moments(sim, KEY)


def width_ratio(post: DataFrame, prior: DataFrame, keys=KEY) -> DataFrame:
    """P90 - P10 of post over that of prior; a prior width of 0 counts as 1."""
    a = column_quantiles(post, (0.1, 0.9), keys).select(*keys, (F.col("p90") - F.col("p10")).alias("w_post"))
    b = column_quantiles(prior, (0.1, 0.9), keys).select(*keys, (F.col("p90") - F.col("p10")).alias("w_prior"))
    return a.join(b, keys).select(*keys, (F.col("w_post") / F.when(F.col("w_prior") != 0, F.col("w_prior")).otherwise(1.0)).alias("width_ratio"))


def median_shift(post: DataFrame, prior: DataFrame, keys=KEY) -> DataFrame:
    a, b = post.groupBy(*keys).agg(F.median("value").alias("m_post")), prior.groupBy(*keys).agg(F.median("value").alias("m_prior"))
    return a.join(b, keys).select(*keys, (F.col("m_post") - F.col("m_prior")).alias("median_shift"))


def crps(sim: DataFrame, truth: DataFrame, keys=KEY) -> DataFrame:
    """Mean absolute error less half the mean pairwise distance, the latter from order statistics: sum of (2k - M - 1) x(k) / M^2."""
    w = Window.partitionBy(*keys)
    ranked = sim.where(F.col("value").isNotNull()).select(*keys, "value", F.row_number().over(w.orderBy("value")).alias("k"), F.count("*").over(w).alias("m"))
    both = ranked.join(truth.select(*keys, "d_obs"), keys)
    return both.groupBy(*keys).agg(
        (
            F.avg(F.abs(F.col("value") - F.col("d_obs"))) - F.sum(
                (2 * F.col("k") - F.col("m") - 1) * F.col("value") / (F.col("m") * F.col("m"))
            )
        ).alias("crps")
    )


def coverage(sim: DataFrame, truth: DataFrame, by=("metric",)) -> DataFrame:
    """Share of entries whose truth lies in the closed P10 to P90 interval."""
    q = column_quantiles(sim, (0.1, 0.9)).join(truth.select(*KEY, "d_obs"), KEY)
    return q.groupBy(*by).agg(F.avg(F.when(F.col("d_obs").between(F.col("p10"), F.col("p90")), 1.0).otherwise(0.0)).alias("coverage"))


def metric_table(post: DataFrame, prior: DataFrame, truth: DataFrame) -> DataFrame:
    """(metric, time): means over wells of width ratio, median shift and CRPS."""
    rows = width_ratio(post, prior).join(median_shift(post, prior), KEY).join(crps(post, truth), KEY, "left")
    return rows.groupBy("metric", "time").agg(*(F.avg(c).alias(c) for c in ("width_ratio", "median_shift", "crps")))


def metric_summary(table: DataFrame) -> DataFrame:
    """Mean and median over times of the per-time means (not of the pooled entries)."""
    cols = ("width_ratio", "median_shift", "crps")
    return table.groupBy("metric").agg(*(F.avg(c).alias(f"mean_{c}") for c in cols), *(F.median(c).alias(f"median_{c}") for c in cols))


def trapezoid(rows: DataFrame, by: list[str], order: list[str], value: str = "value") -> DataFrame:
    """Integral with unit spacing along the order."""
    last = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_step", (F.col(value) + last) / 2).groupBy(*by).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("integral"))


def cumulative_error(post: DataFrame, truth: DataFrame) -> DataFrame:
    """Integral over the entries of a metric (wells one after the other) of the median against that of the truth; relative to the latter or 1."""
    med = post.groupBy(*KEY).agg(F.median("value").alias("m")).join(truth.select(*KEY, "d_obs"), KEY)
    a = trapezoid(med, ["metric"], ["well", "time"], "m").withColumnRenamed("integral", "int_median")
    b = trapezoid(med, ["metric"], ["well", "time"], "d_obs").withColumnRenamed("integral", "int_truth")
    size = F.abs("int_truth")
    return a.join(b, "metric").select(
        "metric", "int_median", "int_truth",
        (F.abs(F.col("int_median") - F.col("int_truth")) / F.when(size > 0, size).otherwise(1.0)).alias("cum_rel_error")
    )


def metrics_summary(setups: dict[str, DataFrame], prior: DataFrame, truth: DataFrame) -> DataFrame:
    """One row for each setup and metric: members, mean width ratio, mean CRPS and coverage. The metric's column is named phase."""
    out = None
    for name, post in setups.items():
        s = metric_summary(metric_table(post, prior, truth)).select("metric", "mean_width_ratio", "mean_median_shift", "mean_crps")
        rows = s.join(coverage(post, truth), "metric", "left").join(post.groupBy("metric").agg(F.count_distinct("member_id").alias("m_members")), "metric")
        rows = rows.select(
            F.lit(name).alias("setup"), F.col("metric").alias("phase"), "m_members", "mean_width_ratio", "mean_median_shift", "mean_crps",
            "coverage"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def build_setups(prior: DataFrame, proxy: DataFrame, inside: DataFrame | None = None, controls: DataFrame | None = None) -> DataFrame:
    """Prior as setup1; the proxy's members, those outside the envelope dropped if `inside` (member_id) is given, as setup2;
    setup3 repeats setup2 with a note unless control data are given."""
    two = proxy if inside is None else proxy.join(inside.select("member_id"), "member_id", "left_semi")
    note2 = "all members" if inside is None else "members outside the envelope dropped"
    three, note3 = (two, "controls are absent; equals setup2") if controls is None else (controls, "with controls")
    cols = ["member_id", "metric", "well", "time", "value"]
    parts = [(prior, "setup1", "posterior is the prior"), (two, "setup2", note2), (three, "setup3", note3)]
    tagged = [p.select(F.lit(s).alias("setup"), *cols, F.lit(n).alias("note")) for p, s, n in parts]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def misfit(sim: DataFrame, truth: DataFrame, keys=KEY) -> DataFrame:
    """d_sim mean and std (0 or unknown counts as 1), residual and residual over std, for each observation."""
    g = sim.groupBy(*keys).agg(F.avg("value").alias("d_sim_mean"), F.stddev_samp("value").alias("s"))
    std = F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)
    return truth.select(*keys, "d_obs").join(g, keys).select(
        *keys, "d_obs", "d_sim_mean", std.alias("d_sim_std"), (F.col("d_sim_mean") - F.col("d_obs")).alias("residual"),
        ((F.col("d_sim_mean") - F.col("d_obs")) / std).alias("residual_z")
    )


def misfit_summary(m: DataFrame, by=("metric",)) -> DataFrame:
    r, z = F.abs("residual"), F.abs("residual_z")
    return m.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col("d_obs") != 0).alias("n_nonzero"), F.avg(r).alias("mean_abs_residual"),
        F.median(r).alias("median_abs_residual"), F.avg(z).alias("mean_abs_z"), F.max(z).alias("max_abs_z")
    )


def residual_heatmap(m: DataFrame, clip: float = 10.0) -> DataFrame:
    """(metric, well) by time: mean residual z, clipped."""
    z = F.least(F.greatest(F.col("residual_z"), F.lit(-clip)), F.lit(clip))
    times = [r.time for r in m.select("time").distinct().orderBy("time").collect()]
    return m.withColumn("z", z).groupBy("metric", "well").pivot("time", times).agg(F.avg("z"))


def field_history_match(sim: DataFrame, truth: DataFrame) -> DataFrame:
    """Field sums: median over members against the observed sum, for each (metric, time)."""
    s = sim.groupBy("member_id", "metric", "time").agg(F.sum("value").alias("v")).groupBy("metric", "time").agg(F.median("v").alias("sim_median"))
    return s.join(truth.groupBy("metric", "time").agg(F.sum("d_obs").alias("obs_total")), ["metric", "time"])


def final_totals(forecast: DataFrame) -> DataFrame:
    """Sum over wells at each metric's last time, for each member."""
    last = F.max("time").over(Window.partitionBy("metric"))
    return forecast.withColumn("_last", last).where("time = _last").groupBy("metric", "member_id").agg(F.sum("value").alias("total"))


def year_end(rows: DataFrame, by: list[str], position: str = "pos") -> DataFrame:
    """The row of the last position of each calendar year (column time holds dates)."""
    w = Window.partitionBy(*by, F.year("time")).orderBy(F.desc(position))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def build_d(sim: DataFrame, mode: str = "cumulative", metrics: list[str] | None = None) -> DataFrame:
    """Observation vector: cumulative values, rates, or both with the rates cut to the named metrics."""
    cum, rate = sim.where("kind = 'cum'"), sim.where("kind = 'rate'")
    if mode == "cumulative":
        return cum
    if mode == "rates":
        return rate
    if mode == "hybrid":
        return cum.unionByName(rate if metrics is None else rate.where(F.col("metric").isin(metrics)))
    raise ValueError(f"unknown mode {mode}")


def split_history(rows: DataFrame, train_years: int, val_years: int) -> DataFrame:
    """Add split: train for the first distinct years, val for the next; later rows are left out.

    Too few years or counts below 1 are errors.
    """
    years = rows.select("time").distinct().count()
    if train_years < 1 or val_years < 1 or years < train_years + val_years:
        raise ValueError(f"{years} years can't be split into {train_years} and {val_years}")
    ranked = rows.select("time").distinct().withColumn("_n", F.dense_rank().over(Window.orderBy("time")))
    split = F.when(F.col("_n") <= train_years, "train").when(F.col("_n") <= train_years + val_years, "val")
    return rows.join(ranked, "time").withColumn("split", split).where("split is not null").drop("_n")


def diag_sigma(
    truth: DataFrame, share: float = 0.15, floor_share: float = 0.01, least: float = 1e-3, zero_metrics: tuple[str, ...] = (),
    zero_sigma: float = 1e6
) -> DataFrame:
    """Noise: a share of |d|, not under a floor from the metric's median; zeros of zero_metrics get zero_sigma."""
    size = F.abs("d_obs")
    floor = F.greatest(F.lit(floor_share) * F.median(size).over(Window.partitionBy("metric")), F.lit(least))
    zero = F.col("metric").isin(list(zero_metrics)) & (size < 1e-9) if zero_metrics else F.lit(False)
    return truth.withColumn("sigma", F.when(zero, zero_sigma).otherwise(F.greatest(F.lit(share) * size, floor)))


def index_filter(rows: DataFrame, kept: DataFrame, keys=KEY) -> DataFrame:
    return rows.join(kept.select(*keys).distinct(), list(keys), "left_semi")


def drop_wells(rows: DataFrame, names: tuple[str, ...] = ("B",)) -> DataFrame:
    return rows.where(~F.col("well").isin(list(names)))


def forecast_anomaly(cum: DataFrame, cutoff: int) -> DataFrame:
    """Values from the cutoff on less the last one before it; no history counts as 0."""
    by = ["member_id", "metric", "well"]
    base = cum.where(F.col("time") < cutoff).groupBy(*by).agg(F.max_by("value", "time").alias("base"))
    late = cum.where(F.col("time") >= cutoff).join(base, by, "left")
    return late.withColumn("value", F.col("value") - F.coalesce("base", F.lit(0.0))).drop("base")


