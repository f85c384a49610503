"""Queries on series and members of the virtual ensemble."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.columns import verdict
from tidewell.operators import linear, members, quantiles, series
from tidewell.plans.registry import query


def rounded(df, digits: dict[str, int] | int = 6, skip: tuple[str, ...] = ()):
    """Doubles rounded, so that engines that add in another order agree."""
    kinds = dict(df.dtypes)
    d = lambda c: digits if isinstance(digits, int) else digits.get(c, 6)
    return df.select(*((F.round(c, d(c)).alias(c) if kinds[c] == "double" and c not in skip else F.col(c)) for c in df.columns))


Q3 = "round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90"


@query("a01_column_quantiles", f"SELECT metric, well, time, {Q3} FROM rates GROUP BY ALL")
def _(v):
    return rounded(series.column_quantiles(v.rates))


@query("a01_quantiles_by_passes", f"SELECT metric, well, time, {Q3} FROM rates GROUP BY ALL")
def _(v):
    return rounded(quantiles.exact_quantiles(v.rates, ["metric", "well", "time"]))


FIELD = f"field AS (SELECT member_id, metric, time, sum(value) AS value FROM rates GROUP BY ALL) SELECT metric, time, round(avg(value), 3) AS mean, round(stddev_samp(value), 3) AS std, {Q3} FROM field GROUP BY ALL"


@query("a02_field_total_quantiles", FIELD)
def _(v):
    return rounded(series.field_total_quantiles(v.rates), {"mean": 3, "std": 3})


@query("a03_per_well_quantiles", f"SELECT metric, well, time, round(avg(value), 3) AS mean, round(stddev_samp(value), 3) AS std, {Q3} FROM rates GROUP BY ALL")
def _(v):
    return rounded(series.per_well_quantiles(v.rates), {"mean": 3, "std": 3})


W = "(quantile_cont({t}.value, 0.9) - quantile_cont({t}.value, 0.1))"
WIDTH = """
wa AS (SELECT metric, well, time, quantile_cont(value, 0.9) - quantile_cont(value, 0.1) AS w FROM post WHERE kind = 'rate' GROUP BY ALL),
wb AS (SELECT metric, well, time, quantile_cont(value, 0.9) - quantile_cont(value, 0.1) AS w FROM rates GROUP BY ALL),
width AS (SELECT wa.metric, wa.well, wa.time, wa.w / CASE WHEN wb.w <> 0 THEN wb.w ELSE 1 END AS width_ratio FROM wa JOIN wb USING (metric,
well, time)),
shifts AS (SELECT metric, well, time, median(a) - median(b) AS median_shift FROM (SELECT p.metric, p.well, p.time, p.value AS a,
r.value AS b FROM post p JOIN rates r USING (member_id, kind, metric, well, time)) GROUP BY ALL),
ordered AS (SELECT metric, well, time, value, row_number() OVER (PARTITION BY metric, well, time ORDER BY value) AS k,
count(*) OVER (PARTITION BY metric, well, time) AS m FROM post WHERE kind = 'rate'),
scores AS (SELECT o.metric, o.well, o.time, avg(abs(value - d_obs)) - sum((2 * k - m - 1) * value / (m * m)) AS crps FROM ordered o
JOIN observed b ON b.metric = o.metric AND b.well = o.well AND b.time = o.time GROUP BY ALL),
"""


def _post(v):
    return v.post(v.sim).where("kind = 'rate'")


@query("a04_width_ratio", WIDTH + "x AS (SELECT 1) SELECT metric, well, time, round(width_ratio, 8) AS width_ratio FROM width")
def _(v):
    return rounded(series.width_ratio(_post(v), v.rates), 8)


@query("a05_median_shift", WIDTH + "x AS (SELECT 1) SELECT metric, well, time, round(median_shift, 4) AS median_shift FROM shifts")
def _(v):
    return rounded(series.median_shift(_post(v), v.rates), 4)


@query("a06_crps", WIDTH + "x AS (SELECT 1) SELECT metric, well, time, round(crps, 6) AS crps FROM scores")
def _(v):
    return rounded(series.crps(_post(v), v.observed), 6)


COVER = """
bands AS (SELECT metric, well, time, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90 FROM post WHERE kind = 'rate'
GROUP BY ALL),
cover AS (SELECT b.metric, avg(CASE WHEN d_obs BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END) AS coverage FROM bands b
JOIN observed o ON o.metric = b.metric AND o.well = b.well AND o.time = b.time GROUP BY ALL),
"""


@query("a07_coverage", COVER + "x AS (SELECT 1) SELECT metric, round(coverage, 8) AS coverage FROM cover")
def _(v):
    return rounded(series.coverage(_post(v), v.observed), 8)


TABLE = WIDTH + """
metric_rows AS (SELECT metric, time, avg(width_ratio) AS width_ratio, avg(median_shift) AS median_shift, avg(crps) AS crps FROM width
JOIN shifts USING (metric, well, time) LEFT JOIN scores USING (metric, well, time) GROUP BY ALL),
"""


@query(
    "a08_metric_table",
    TABLE + """
x AS (SELECT 1) SELECT metric, time, round(width_ratio, 8) AS width_ratio, round(median_shift, 3) AS median_shift, round(crps, 3) AS crps
FROM metric_rows"""
)
def _(v):
    return rounded(series.metric_table(_post(v), v.rates, v.observed), {"width_ratio": 8, "median_shift": 3, "crps": 3})


@query(
    "a08_metric_summary",
    TABLE + """
x AS (SELECT 1) SELECT metric, round(avg(width_ratio), 8) AS mean_width_ratio, round(avg(median_shift), 3) AS mean_median_shift,
round(avg(crps), 3) AS mean_crps, round(median(width_ratio), 8) AS median_width_ratio, round(median(median_shift),
3) AS median_median_shift, round(median(crps), 3) AS median_crps FROM metric_rows GROUP BY ALL"""
)
def _(v):
    s = series.metric_summary(series.metric_table(_post(v), v.rates, v.observed))
    return rounded(s, {"mean_width_ratio": 8, "median_width_ratio": 8, "mean_median_shift": 3, "mean_crps": 3, "median_median_shift": 3, "median_crps": 3})


@query("a09_cumulative_error", """
med AS (SELECT p.metric, p.well, p.time, median(value) AS m, any_value(d_obs) AS d FROM post p
JOIN observed o ON o.kind = p.kind AND o.metric = p.metric AND o.well = p.well AND o.time = p.time GROUP BY ALL),
steps AS (SELECT metric, (m + lag(m) OVER w) / 2 AS a, (d + lag(d) OVER w) / 2 AS b FROM med WINDOW w AS (PARTITION BY metric ORDER BY well,
time)),
ints AS (SELECT metric, coalesce(sum(a), 0) AS int_median, coalesce(sum(b), 0) AS int_truth FROM steps GROUP BY ALL)
SELECT metric, round(int_median, 3) AS int_median, round(int_truth, 3) AS int_truth,
round(abs(int_median - int_truth) / CASE WHEN abs(int_truth) > 0 THEN abs(int_truth) ELSE 1 END, 8) AS cum_rel_error FROM ints""")
def _(v):
    return rounded(series.cumulative_error(_post(v), v.observed), {"int_median": 3, "int_truth": 3, "cum_rel_error": 8})


@query(
    "m24_trapezoid",
    """
steps AS (SELECT metric, well, (d_obs + lag(d_obs) OVER (PARTITION BY metric, well ORDER BY time)) / 2 AS s FROM observed) SELECT metric,
well, round(coalesce(sum(s), 0), 4) AS integral FROM steps GROUP BY ALL"""
)
def _(v):
    return rounded(series.trapezoid(v.observed, ["metric", "well"], ["time"], "d_obs"), 4)


SUMMARY = """
SELECT 'setup1' AS setup, m.metric AS phase, n AS m_members, 1.0::DOUBLE AS mean_width_ratio, round(0.0::DOUBLE, 3) AS mean_median_shift,
round(c1, 3) AS mean_crps, round(v1, 8) AS coverage FROM own m
UNION ALL SELECT 'setup2', t.metric, n, round(t.w, 8), round(t.s, 3), round(t.c, 3), round(cover.coverage, 8) FROM two t
JOIN own USING (metric) JOIN cover USING (metric)
"""


@query("a10_metrics_summary", TABLE + COVER + """
two AS (SELECT metric, avg(width_ratio) AS w, avg(median_shift) AS s, avg(crps) AS c FROM metric_rows GROUP BY ALL),
oo AS (SELECT metric, well, time, value, row_number() OVER (PARTITION BY metric, well, time ORDER BY value) AS k,
count(*) OVER (PARTITION BY metric, well, time) AS m FROM rates),
o1 AS (SELECT o.metric, o.well, o.time, avg(abs(value - d_obs)) - sum((2 * k - m - 1) * value / (m * m)) AS crps FROM oo o
JOIN observed b ON b.metric = o.metric AND b.well = o.well AND b.time = o.time GROUP BY ALL),
o2 AS (SELECT metric, avg(c) AS c1 FROM (SELECT metric, time, avg(crps) AS c FROM o1 GROUP BY ALL) GROUP BY ALL),
b1 AS (SELECT metric, well, time, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90 FROM rates GROUP BY ALL),
b2 AS (SELECT b.metric, avg(CASE WHEN d_obs BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END) AS v1 FROM b1 b
JOIN observed o ON o.metric = b.metric AND o.well = b.well AND o.time = b.time GROUP BY ALL),
own AS (SELECT r.metric, count(DISTINCT member_id) AS n, any_value(c1) AS c1, any_value(v1) AS v1 FROM rates r
JOIN o2 ON o2.metric = r.metric JOIN b2 ON b2.metric = r.metric GROUP BY ALL)
""" + SUMMARY)
def _(v):
    out = series.metrics_summary({"setup1": v.rates, "setup2": _post(v)}, v.rates, v.observed)
    return rounded(out, {"mean_width_ratio": 8, "mean_median_shift": 3, "mean_crps": 3, "coverage": 8})


@query("a11_setups", """
box AS (SELECT comp, min(value) AS lo, max(value) AS hi FROM theta GROUP BY ALL),
inside AS (SELECT member_id FROM theta_post JOIN box USING (comp) GROUP BY ALL HAVING bool_and(value BETWEEN lo AND hi)),
s AS (SELECT 'setup1' AS setup, 'posterior is the prior' AS note, metric, value FROM rates
  UNION ALL SELECT 'setup2', 'members outside the envelope dropped', metric, value FROM post SEMI JOIN inside USING (member_id) WHERE kind = 'rate'
  UNION ALL SELECT 'setup3', 'controls are absent; equals setup2', metric, value FROM post SEMI JOIN inside USING (member_id) WHERE kind = 'rate')
SELECT setup, note, metric, count(*) AS n, round(avg(value), 4) AS mean FROM s GROUP BY ALL""")
def _(v):
    inside = members.in_envelope(v.theta_post, v.theta).where("in_envelope")
    return rounded(
        series.build_setups(v.rates, _post(v), inside).groupBy("setup", "note", "metric").agg(
            F.count("*").alias("n"), F.avg("value").alias("mean")
        ),
        4
    )


MISFIT = """
g AS (SELECT metric, well, time, avg(value) AS mu, stddev_samp(value) AS s FROM rates GROUP BY ALL),
mis AS (SELECT o.metric, o.well, o.time, d_obs, mu AS d_sim_mean, CASE WHEN s > 0 THEN s ELSE 1 END AS d_sim_std, mu - d_obs AS residual,
(mu - d_obs) / CASE WHEN s > 0 THEN s ELSE 1 END AS residual_z FROM observed o
JOIN g ON g.metric = o.metric AND g.well = o.well AND g.time = o.time)
"""


@query(
    "a12_misfit",
    MISFIT + """
SELECT metric, well, time, round(d_obs, 4) AS d_obs, round(d_sim_mean, 4) AS d_sim_mean, round(d_sim_std, 3) AS d_sim_std, round(residual,
4) AS residual, round(residual_z, 7) AS residual_z FROM mis"""
)
def _(v):
    return rounded(series.misfit(v.rates, v.observed), {"d_obs": 4, "d_sim_mean": 4, "d_sim_std": 3, "residual": 4, "residual_z": 7})


@query(
    "a13_misfit_summary",
    MISFIT + """
SELECT metric, count(*) AS n, count(*) FILTER (WHERE d_obs <> 0) AS n_nonzero, round(avg(abs(residual)), 3) AS mean_abs_residual,
round(median(abs(residual)), 3) AS median_abs_residual, round(avg(abs(residual_z)), 7) AS mean_abs_z, round(max(abs(residual_z)),
7) AS max_abs_z FROM mis GROUP BY ALL"""
)
def _(v):
    return rounded(
        series.misfit_summary(series.misfit(v.rates, v.observed)),
        {"mean_abs_residual": 3, "median_abs_residual": 3, "mean_abs_z": 7, "max_abs_z": 7}
    )


@query(
    "a44_residual_heatmap",
    MISFIT + """
, z AS (SELECT metric, well, time, least(greatest(residual_z, -10), 10) AS z FROM mis) SELECT metric, well,
round(avg(z) FILTER (WHERE time = 1995), 7) AS y1995, round(avg(z) FILTER (WHERE time = 1998), 7) AS y1998,
round(avg(z) FILTER (WHERE time = 2001), 7) AS y2001 FROM z GROUP BY ALL"""
)
def _(v):
    h = series.residual_heatmap(series.misfit(v.rates, v.observed))
    return rounded(h.select("metric", "well", *(F.col(y).alias(f"y{y}") for y in ("1995", "1998", "2001"))), 7)


@query(
    "a45_field_history_match",
    """
f AS (SELECT member_id, metric, time, sum(value) AS v FROM rates GROUP BY ALL), m AS (SELECT metric, time, median(v) AS sim_median FROM f
GROUP BY ALL) SELECT metric, time, round(sim_median, 6) AS sim_median, round(obs_total, 6) AS obs_total FROM m JOIN (SELECT metric, time,
sum(d_obs) AS obs_total FROM observed GROUP BY ALL) o USING (metric, time)"""
)
def _(v):
    return rounded(series.field_history_match(v.rates, v.observed), 6)


@query("a46_final_totals", "SELECT metric, member_id, round(sum(value), 3) AS total FROM forecast WHERE time = (SELECT max(time) FROM forecast) GROUP BY ALL")
def _(v):
    return rounded(series.final_totals(v.forecast), 3)


@query("a14_spread_retention", """
a AS (SELECT comp, stddev_samp(value) AS std_prior FROM theta GROUP BY ALL), b AS (SELECT comp, stddev_samp(value) AS std_post
FROM theta_post GROUP BY ALL)
SELECT comp, round(std_prior, 6) AS std_prior, round(std_post, 6) AS std_post, round(std_post / std_prior, 8) AS ratio,
std_post / std_prior < 0.1 AS collapsed, std_post / std_prior > 1.5 AS blown_up FROM a JOIN b USING (comp)""")
def _(v):
    return rounded(members.spread_retention(v.theta, v.theta_post), {"ratio": 8})


SHIFT = """
ca AS (SELECT cluster_id, comp, avg(value) AS prior_mean FROM theta GROUP BY ALL), cb AS (SELECT cluster_id, comp, avg(value) AS post_mean
FROM theta_post GROUP BY ALL),
sg AS (SELECT comp, stddev_samp(value) AS sigma FROM theta GROUP BY ALL),
shifted AS (SELECT cluster_id, comp, prior_mean, post_mean, post_mean - prior_mean AS shift, (post_mean - prior_mean) / sigma AS shift_sigma
FROM ca JOIN cb USING (cluster_id, comp) JOIN sg USING (comp))
"""


@query(
    "a15_centroid_shift",
    SHIFT + """
SELECT cluster_id, comp, round(prior_mean, 6) AS prior_mean, round(post_mean, 6) AS post_mean, round(shift, 6) AS shift, round(shift_sigma,
7) AS shift_sigma FROM shifted"""
)
def _(v):
    return rounded(members.centroid_shift(v.theta, v.theta_post), {"shift_sigma": 7})


@query("a16_cluster_migration", """
a AS (SELECT cluster_id, comp, avg(value) AS prior FROM theta GROUP BY ALL), b AS (SELECT cluster_id, comp, avg(value) AS post
FROM theta_post GROUP BY ALL),
c AS (SELECT cluster_id, comp, avg(value) AS reference FROM theta WHERE member_id % 2 = 0 AND cluster_id < 4 GROUP BY ALL)
SELECT cluster_id, comp, round(prior, 6) AS prior, round(post, 6) AS post, round(reference, 6) AS reference, round(post - prior,
6) AS d_post_prior, round(prior - reference, 6) AS d_prior_reference, round(post - reference, 6) AS d_post_reference FROM a
JOIN b USING (cluster_id, comp) LEFT JOIN c USING (cluster_id, comp)""")
def _(v):
    return rounded(members.cluster_migration(v.theta, v.theta_post, v.theta.where("member_id % 2 = 0 and cluster_id < 4")))


BOX = "box AS (SELECT comp, min(value) AS lo, max(value) AS hi FROM theta GROUP BY ALL)"


@query(
    "a17_physical_bounds",
    BOX + """
 SELECT comp, round(lo, 6) AS lo, round(hi, 6) AS hi, round(min(value), 6) AS post_min, round(max(value), 6) AS post_max,
count(*) FILTER (WHERE value < lo) AS n_below, count(*) FILTER (WHERE value > hi) AS n_above,
count(*) FILTER (WHERE value < lo OR value > hi) AS n_outside FROM theta_post JOIN box USING (comp) GROUP BY comp, lo, hi"""
)
def _(v):
    return rounded(members.physical_bounds(v.theta, v.theta_post))


@query("a18_duplicate_models", """
dup AS (SELECT *, count(*) OVER (PARTITION BY model_id) AS n, row_number() OVER (PARTITION BY model_id ORDER BY ord) AS r FROM members
QUALIFY n > 1),
sh AS (SELECT a.member_id, sqrt(sum((b.value - a.value) * (b.value - a.value))) AS shift FROM theta a JOIN theta_post b USING (member_id,
comp) GROUP BY ALL),
g AS (SELECT model_id, count(*) AS n_copies, avg(shift) AS mean_shift, string_agg(cluster_id::VARCHAR, ',' ORDER BY ord) AS clusters
FROM dup JOIN sh USING (member_id) GROUP BY ALL),
gap AS (SELECT x.model_id, sqrt(sum((p.value - q.value) * (p.value - q.value))) AS distance FROM dup x
JOIN dup y ON x.model_id = y.model_id AND x.r = 1 AND y.r = 2 JOIN theta_post p ON p.member_id = x.member_id
JOIN theta_post q ON q.member_id = y.member_id AND q.comp = p.comp GROUP BY ALL)
SELECT model_id, n_copies, round(mean_shift, 6) AS mean_shift, round(distance, 6) AS distance, round(distance / greatest(mean_shift, 1e-9),
7) AS ratio, clusters FROM g JOIN gap USING (model_id)""")
def _(v):
    return rounded(members.duplicate_models(v.members, v.theta, v.theta_post), {"ratio": 7})


@query("a19_bimodality", """
z AS (SELECT comp, cluster_id, count(*) OVER w AS n, stddev_samp(value) OVER w AS s,
(value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM theta WINDOW w AS (PARTITION BY comp, cluster_id)),
g AS (SELECT comp, cluster_id, max(n) AS n, max(s) AS s, avg(z * z * z) AS skew, avg(z * z * z * z) - 3 AS kurt FROM z GROUP BY ALL),
d AS (SELECT *, kurt + 3.0::DOUBLE * (n - 1) * (n - 1) / nullif((n - 2) * (n - 3), 0) AS denom FROM g)
SELECT comp, cluster_id, round(CASE WHEN n >= 4 AND s > 0 AND denom > 0 THEN (skew * skew + 1) / denom ELSE 0 END, 7) AS bimodality FROM d""")
def _(v):
    return rounded(members.bimodality(v.theta, ["comp", "cluster_id"]), 7)


@query("a20_diag_sigma", """
f AS (SELECT *, greatest(0.01 * median(abs(d_obs)) OVER (PARTITION BY metric), 1e-3) AS fl FROM observed)
SELECT metric, well, time, round(d_obs, 4) AS d_obs,
round(CASE WHEN metric = 'disc' AND abs(d_obs) < 1e-9 THEN 1e6 ELSE greatest(0.15 * abs(d_obs), fl) END, 5) AS sigma FROM f""")
def _(v):
    return rounded(series.diag_sigma(v.observed, zero_metrics=("disc",)).select("metric", "well", "time", "d_obs", "sigma"), {"d_obs": 4, "sigma": 5})


@query(
    "a21_deduplicate",
    """
SELECT m.model_id, a.comp, round(avg(b.value), 6) AS theta_post, round(min_by(a.value, ord), 6) AS theta_prior, min_by(m.cluster_id,
ord) AS cluster_id, min_by(m.seed, ord) AS seed, min(ord) AS first_ord, count(*) - 1 AS n_collapsed FROM theta a
JOIN theta_post b USING (member_id, comp) JOIN members m USING (member_id) GROUP BY m.model_id, a.comp"""
)
def _(v):
    return rounded(members.deduplicate(v.members, v.theta, v.theta_post))


@query(
    "f01_state_vector",
    """
SELECT member_id, comp, comp_pos, round(value, 6) AS value, 'theta' AS block FROM theta UNION ALL SELECT member_id, 'seed', 4, seed::DOUBLE,
'control' FROM members WHERE member_id IN (SELECT member_id FROM theta)"""
)
def _(v):
    controls = v.members.join(v.theta.select("member_id").distinct(), "member_id", "left_semi").select(
        "member_id", F.lit("seed").alias("comp"), F.lit(0).alias("comp_pos"), F.col("seed").cast("double").alias("value")
    )
    return rounded(members.state_vector(v.theta, controls))


@query(
    "f02_unpack",
    """
SELECT member_id, 'theta' AS block, comp_pos AS pos, round(value, 6) AS value FROM theta WHERE comp_pos < 3 UNION ALL SELECT member_id,
'control', 0, round(value, 6) FROM theta WHERE comp_pos = 3"""
)
def _(v):
    return rounded(members.unpack(members.pack(members.state_vector(v.theta)), {"theta": (0, 3), "control": (3, 1)}, 4))


@query("f03_index_filter", "SELECT kind, metric, well, time, count(*) AS n FROM rates WHERE time >= 1998 GROUP BY ALL")
def _(v):
    return series.index_filter(v.rates, v.observed.where("time >= 1998")).groupBy("kind", "metric", "well", "time").agg(F.count("*").alias("n"))


@query(
    "f04_split_history",
    """
y AS (SELECT time, dense_rank() OVER (ORDER BY time) AS n FROM (SELECT DISTINCT time FROM rates))
SELECT CASE WHEN n <= 4 THEN 'train' ELSE 'val' END AS split, metric, time, count(*) AS n, round(sum(value), 3) AS total FROM rates
JOIN y USING (time) WHERE n <= 6 GROUP BY ALL"""
)
def _(v):
    return rounded(series.split_history(v.rates, 4, 2).groupBy("split", "metric", "time").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 3)


@query(
    "f05_clip_to_prior",
    BOX + """
 SELECT member_id, comp, round(least(greatest(value, lo), hi), 6) AS value, value < lo OR value > hi AS clipped FROM theta_post
JOIN box USING (comp)"""
)
def _(v):
    return rounded(members.clip_to_prior(v.theta_post, v.theta).select("member_id", "comp", "value", "clipped"))


@query("f06_drop_wells", "SELECT well, count(*) AS n FROM rates WHERE well <> 'N' GROUP BY ALL")
def _(v):
    return series.drop_wells(v.rates, ("N",)).groupBy("well").agg(F.count("*").alias("n"))


@query(
    "f07_build_d_hybrid",
    "SELECT kind, metric, count(*) AS n, round(sum(value), 2) AS total FROM sim WHERE kind = 'cum' OR metric IN ('qty', 'rev') GROUP BY ALL"
)
def _(v):
    return rounded(series.build_d(v.sim, "hybrid", ["qty", "rev"]).groupBy("kind", "metric").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 2)


@query(
    "f08_annual_snapshots",
    """
e AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events) SELECT user_id,
year(ts)::BIGINT AS year, max(pos) AS pos, round(max_by(value, pos), 6) AS value FROM e GROUP BY ALL"""
)
def _(v):
    from pyspark.sql import Window

    e = v.table("events").withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    return rounded(e.groupBy("user_id", F.year("ts").cast("long").alias("year")).agg(F.max("pos").alias("pos"), F.max_by("value", "pos").alias("value")))


@query("f09_year_end_rows", "SELECT l_suppkey AS member_id, year(l_shipdate)::BIGINT AS year, max(l_shipdate) AS last_date FROM lineitem GROUP BY ALL")
def _(v):
    rows = v.table("lineitem").select(F.col("l_suppkey").alias("member_id"), F.col("l_shipdate").alias("time"), F.col("l_shipdate").alias("pos"))
    return series.year_end(rows, ["member_id"]).select("member_id", F.year("time").cast("long").alias("year"), F.col("time").alias("last_date"))


@query(
    "f10_in_envelope",
    """
b2 AS (SELECT cluster_id, comp, min(value) AS lo, max(value) AS hi FROM theta WHERE member_id % 3 = 0 GROUP BY ALL) SELECT member_id,
bool_and(coalesce(value BETWEEN lo AND hi, false)) AS in_envelope FROM theta_post LEFT JOIN b2 USING (cluster_id, comp) GROUP BY ALL"""
)
def _(v):
    return members.in_envelope(v.theta_post, v.theta.where("member_id % 3 = 0"), ["cluster_id"])


@query(
    "f11_envelope_drop",
    BOX + """
, i AS (SELECT member_id FROM theta_post JOIN box USING (comp) GROUP BY ALL HAVING bool_and(value BETWEEN lo AND hi)) SELECT metric,
count(DISTINCT member_id) AS members FROM rates SEMI JOIN i USING (member_id) GROUP BY ALL"""
)
def _(v):
    inside = members.in_envelope(v.theta_post, v.theta).where("in_envelope")
    return series.build_setups(v.rates, v.rates, inside).where("setup = 'setup2'").groupBy("metric").agg(F.count_distinct("member_id").alias("members"))


def _mixed(v):
    """Three components, one of them a sum of the others: that takes away a rank."""
    both = v.theta.where("comp in ('price', 'size')")
    mixed = both.groupBy("member_id").agg(
        F.sum(F.when(F.col("comp") == "price", F.col("value")).otherwise(-3 * F.col("value"))).alias("value")
    ).select("member_id", F.lit("mixed").alias("comp"), "value")
    return both.select("member_id", "comp", "value").unionByName(mixed)


@query("f15_messages", """
o AS (SELECT count(*) AS n FROM theta_post JOIN (SELECT comp, min(value) AS lo, max(value) AS hi FROM theta GROUP BY ALL) b USING (comp)
WHERE value < lo OR value > hi),
u AS (SELECT count(*) AS n FROM (SELECT model_id FROM members GROUP BY ALL HAVING count(*) > 1)),
r AS (SELECT count_if(r < 0.1) AS c, count_if(r > 1.5) AS b, count(*) AS n FROM (SELECT stddev_samp(q.value) / stddev_samp(p.value) AS r FROM theta p
JOIN theta_post q USING (member_id, comp) GROUP BY comp)),
cs AS (SELECT member_id, max(value) FILTER (WHERE comp = 'price') AS a, max(value) FILTER (WHERE comp = 'size') AS b FROM theta GROUP BY ALL),
q3 AS (SELECT count(*) AS n, corr(a, b) AS ab, corr(a, a - 3 * b) AS ac, corr(b, a - 3 * b) AS bc FROM cs),
rk AS (SELECT CASE WHEN 1 + 2 * ab * ac * bc - ab ** 2 - ac ** 2 - bc ** 2 > 1e-9 THEN 3 WHEN least(ab ** 2, ac ** 2, bc ** 2) < 1 - 1e-9 THEN 2 ELSE 1 END AS k, least(n - 1, 3) AS f FROM q3),
zb AS (SELECT count(*) OVER () AS n, (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS z FROM theta_post WHERE comp = 'bal'),
bi AS (SELECT (avg(z ** 3) ** 2 + 1) / (avg(z ** 4) - 3 + 3.0::DOUBLE * (max(n) - 1) ** 2 / ((max(n) - 2) * (max(n) - 3))) AS v FROM zb)
SELECT 'ERROR' AS level, c || ' component(s) collapsed' AS text FROM r WHERE c > 0
UNION ALL SELECT 'WARN', b || ' component(s) blew up' FROM r WHERE b * 2 > n
UNION ALL SELECT 'WARN', n || ' value(s) outside the prior''s range' FROM o WHERE n > 0
UNION ALL SELECT 'INFO', n || ' model(s) occur more than once' FROM u WHERE n > 0
UNION ALL SELECT 'WARN', 'rank ' || k || ' is below ' || f FROM rk WHERE k < f
UNION ALL SELECT 'WARN', 'the posterior looks bimodal' FROM bi WHERE v > 0.3""")
def _(v):
    rank = linear.component_rank(_mixed(v)).first()
    bimodal = members.bimodality(v.theta_post.where("comp = 'bal'"), ["comp"]).first()["bimodality"]
    return members.messages(
        members.spread_retention(v.theta, v.theta_post), members.physical_bounds(v.theta, v.theta_post),
        members.duplicate_models(v.members, v.theta, v.theta_post), rank["rank"], rank["full"] + 1, 3, bimodal
    )


DISTANCE = """
pr AS (SELECT a.member_id, a.value AS x, b.value AS y FROM theta a
JOIN theta b ON a.member_id = b.member_id AND a.comp = 'price' AND b.comp = 'size'),
po AS (SELECT a.member_id, a.value AS x, b.value AS y FROM theta_post a
JOIN theta_post b ON a.member_id = b.member_id AND a.comp = 'price' AND b.comp = 'size'),
cv AS (SELECT var_samp(x) + 1e-12 AS a, covar_samp(x, y) AS b, var_samp(y) + 1e-12 AS c FROM pr),
dist AS (SELECT pr.member_id,
sqrt(((po.x - pr.x) ** 2 * c - 2 * (po.x - pr.x) * (po.y - pr.y) * b + (po.y - pr.y) ** 2 * a) / (a * c - b * b)) AS distance FROM pr
JOIN po USING (member_id), cv),
ranked AS (SELECT d.member_id, m.cluster_id, m.model_id, m.ord, d.distance, row_number() OVER (ORDER BY round(distance, 8) DESC,
m.ord) AS rank FROM dist d JOIN members m USING (member_id))
"""


def _ranking(v):
    two = F.col("comp").isin("price", "size")
    d = linear.mahalanobis(v.theta.where(two), v.theta_post.where(two)).join(v.members, "member_id")
    return members.rank_members(d.withColumn("rounded", F.round("distance", 8)), "rounded").drop("rounded")


@query("m07_mahalanobis", DISTANCE + "SELECT member_id, round(distance, 6) AS distance FROM dist")
def _(v):
    return rounded(_ranking(v).select("member_id", "distance"))


@query("t01_rank_members", DISTANCE + "SELECT member_id, model_id, cluster_id, rank, round(distance, 6) AS distance FROM ranked")
def _(v):
    return rounded(_ranking(v).select("member_id", "model_id", "cluster_id", F.col("rank").cast("long").alias("rank"), "distance"))


@query("t02_resimulation_plan", DISTANCE + """,
pool AS (SELECT * FROM ranked WHERE rank > 10), cl AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) AS c,
count(*) OVER () AS n FROM (SELECT DISTINCT cluster_id FROM pool)),
picked AS (SELECT p.member_id, p.ord, row_number() OVER (PARTITION BY p.cluster_id ORDER BY md5('5-' || p.member_id), p.member_id) AS r,
greatest(1, 12 // n) + CASE WHEN c <= 12 % n THEN 1 ELSE 0 END AS quota FROM pool p JOIN cl USING (cluster_id)),
chosen AS (SELECT member_id FROM (SELECT *, row_number() OVER (ORDER BY ord) AS o FROM picked WHERE r <= quota) WHERE o <= 12)
SELECT member_id, rank, CASE WHEN rank <= 10 THEN 'resimulate' ELSE 'proxy' END AS role, member_id IN (SELECT member_id
FROM chosen) AS validate FROM ranked""")
def _(v):
    return members.plan_resimulation(_ranking(v), 10, 12, 5).select("member_id", F.col("rank").cast("long").alias("rank"), "role", "validate")


@query("t03_stratified_choice", """
cl AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) AS c, count(*) OVER () AS n FROM (SELECT DISTINCT cluster_id
FROM members)),
picked AS (SELECT p.*, row_number() OVER (PARTITION BY p.cluster_id ORDER BY md5('9-' || p.member_id), p.member_id) AS r, greatest(1,
17 // n) + CASE WHEN c <= 17 % n THEN 1 ELSE 0 END AS quota FROM members p JOIN cl USING (cluster_id))
SELECT member_id, cluster_id FROM (SELECT *, row_number() OVER (ORDER BY ord) AS o FROM picked WHERE r <= quota) WHERE o <= 17""")
def _(v):
    return members.stratified_choice(v.members, 17, 9).select("member_id", "cluster_id")


@query(
    "t04_stratified_split",
    """
SELECT member_id, cluster_id, CASE WHEN row_number() OVER (PARTITION BY cluster_id ORDER BY md5('3-' || member_id),
member_id) <= greatest(1, round_even(count(*) OVER (PARTITION BY cluster_id) * 0.2, 0)) THEN 'val' ELSE 'train' END AS split FROM members"""
)
def _(v):
    return members.stratified_split(v.members, 0.2, 3).select("member_id", "cluster_id", "split")


CORR = """
zd AS (SELECT t.comp, r.metric, r.well, r.time, t.value AS z, r.value AS d FROM theta t JOIN rates r USING (member_id)),
cor AS (SELECT comp, metric, well, time, coalesce(covar_samp(z, d) / nullif(stddev_samp(z) * stddev_samp(d), 0), 0) AS r, count(*) AS n FROM zd GROUP BY ALL)
"""


@query("m01_correlation", CORR + "SELECT comp, metric, well, time, round(r, 7) AS r, n FROM cor")
def _(v):
    return rounded(linear.correlation(v.theta, v.rates), 7)


@query(
    "m02_localization_hard",
    CORR + """
SELECT comp, metric, well, time, round(2.0 / sqrt(n), 8) AS threshold,
CASE WHEN abs(r) >= 2.0 / sqrt(n) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mask FROM cor"""
)
def _(v):
    return rounded(linear.localization(linear.correlation(v.theta, v.rates), 2.0).select("comp", "metric", "well", "time", "threshold", "mask"), 8)


@query(
    "m02_localization_soft",
    CORR + """
, t AS (SELECT *, abs(r) AS a, 1.0 / sqrt(n) AS t FROM cor) SELECT comp, metric, well, time,
round(CASE WHEN a >= t + 0.05 THEN 1.0 WHEN a <= t - 0.05 THEN 0.0 ELSE 0.5 * (1 - cos(pi() * (a - t + 0.05) / 0.1)) END, 6) AS mask FROM t"""
)
def _(v):
    return rounded(linear.localization(linear.correlation(v.theta, v.rates), 1.0, "soft", 0.05).select("comp", "metric", "well", "time", "mask"))


@query(
    "a48_localization_summary",
    CORR + """
SELECT count(*) FILTER (WHERE abs(r) >= 2.0 / sqrt(n)) AS kept, count(*) AS total,
round(100.0 * count(*) FILTER (WHERE abs(r) >= 2.0 / sqrt(n)) / count(*), 6) AS percent FROM cor"""
)
def _(v):
    return rounded(linear.localization_summary(linear.localization(linear.correlation(v.theta, v.rates), 2.0)))


TWO = """
ob AS (SELECT well, time, d_obs, 0.15 * abs(d_obs) AS sigma FROM observed WHERE metric = 'qty' AND well = 'A' AND time IN (1997, 1998)),
w2 AS (SELECT member_id, max(CASE WHEN r.time = 1997 THEN value END) AS d1, max(CASE WHEN r.time = 1998 THEN value END) AS d2,
max(CASE WHEN r.time = 1997 THEN d_obs END) AS y1, max(CASE WHEN r.time = 1998 THEN d_obs END) AS y2,
max(CASE WHEN r.time = 1997 THEN sigma END) AS s1, max(CASE WHEN r.time = 1998 THEN sigma END) AS s2 FROM rates r
JOIN ob ON ob.well = r.well AND ob.time = r.time WHERE r.metric = 'qty' GROUP BY ALL),
zz AS (SELECT t.member_id, comp, value, w2.* EXCLUDE (member_id) FROM theta t JOIN w2 USING (member_id)),
kk AS (SELECT comp, covar_samp(value, d1) AS c1, covar_samp(value, d2) AS c2, var_samp(d1) + max(s1) ** 2 AS a,
var_samp(d2) + max(s2) ** 2 AS b, covar_samp(d1, d2) AS c FROM zz GROUP BY ALL)
SELECT member_id, comp, round(value + (c1 * b - c2 * c) / (a * b - c * c) * (y1 - d1) + (c2 * a - c1 * c) / (a * b - c * c) * (y2 - d2),
5) AS value FROM zz JOIN kk USING (comp)"""


def _two(v):
    return v.observed.where("metric = 'qty' and well = 'A' and time in (1997, 1998)").withColumn("sigma", 0.15 * F.abs("d_obs"))


@query("m04_update_two_observations", TWO)
def _(v):
    return rounded(linear.update_two(v.theta, v.rates, _two(v)), 5)


@query("m04_ensemble_update", TWO)
def _(v):
    return rounded(linear.ensemble_update(v.theta, v.rates, _two(v), energy=1.0, perturb=False).select("member_id", "comp", "value"), 5)


@query("m04_localized_update")
def _(v):
    truth = series.diag_sigma(v.observed)
    mask = linear.localization(linear.correlation(v.theta, v.rates), 2.0)
    return linear.ensemble_update(v.theta, v.rates, truth, mask, energy=0.99, seed=42).select("member_id", "comp", "value")


PROXY1 = """
q1 AS (SELECT member_id, cluster_id, value AS z FROM theta WHERE comp = 'price'),
fd AS (SELECT member_id, metric, well, time, value AS d FROM forecast),
px AS (SELECT cluster_id, metric, well, time, count(*) AS n_train, avg(z) AS z_mean, avg(d) AS d_mean, min(z) AS lo, max(z) AS hi,
covar_samp(z, d) / (var_samp(z) + 1e-8) AS slope, stddev_samp(d) AS sigma FROM q1 JOIN fd USING (member_id) GROUP BY ALL
HAVING count(*) >= 2)
"""


def _price(v):
    return v.theta.where("comp = 'price'")


@query(
    "m08_simple_proxies",
    PROXY1 + """
SELECT cluster_id, metric, well, time, n_train, round(z_mean, 6) AS z_mean, round(d_mean, 4) AS d_mean, round(lo, 6) AS lo, round(hi,
6) AS hi, round(slope, 6) AS slope FROM px"""
)
def _(v):
    return rounded(linear.simple_proxies(_price(v), v.forecast).drop("sigma"), {"d_mean": 4})


@query(
    "m08_build_proxies",
    PROXY1 + "SELECT cluster_id, 'price' AS comp, metric || '|' || well || '|' || time AS pos, n_train, round(slope, 6) AS slope FROM px"
)
def _(v):
    return rounded(linear.build_proxies(_price(v), v.forecast).select("cluster_id", "comp", "pos", "n_train", "slope"))


@query(
    "m12_predict",
    PROXY1 + """
, pp AS (SELECT member_id, cluster_id, value AS z FROM theta_post WHERE comp = 'price') SELECT member_id,
metric || '|' || well || '|' || time AS pos, round(d_mean + (z - z_mean) * slope, 4) AS predicted, coalesce(z BETWEEN lo AND hi,
false) AS in_envelope FROM pp LEFT JOIN px USING (cluster_id)"""
)
def _(v):
    p = linear.build_proxies(_price(v), v.forecast)
    return rounded(linear.predict(p, v.theta_post.where("comp = 'price'")), 4)


VALID = """
sp AS (SELECT member_id, CASE WHEN row_number() OVER (PARTITION BY cluster_id ORDER BY md5('3-' || member_id), member_id) <= greatest(1,
round_even(count(*) OVER (PARTITION BY cluster_id) * 0.2, 0)) THEN 'val' ELSE 'train' END AS split FROM members),
q1 AS (SELECT t.member_id, t.cluster_id, value AS z, split FROM theta t JOIN sp USING (member_id) WHERE comp = 'price'),
fd AS (SELECT member_id, metric, well, time, value AS d FROM forecast),
px AS (SELECT cluster_id, metric, well, time, avg(z) AS z_mean, avg(d) AS d_mean, covar_samp(z, d) / (var_samp(z) + 1e-8) AS slope,
stddev_samp(d) AS sigma FROM q1 JOIN fd USING (member_id) WHERE split = 'train' GROUP BY ALL HAVING count(*) >= 2),
er AS (SELECT q1.cluster_id, q1.member_id, median(abs(d_mean + slope * (z - z_mean) - d) / CASE WHEN sigma > 1 THEN sigma ELSE 1 END) AS e
FROM q1 JOIN fd USING (member_id) JOIN px ON px.cluster_id = q1.cluster_id AND px.metric = fd.metric AND px.well = fd.well AND px.time = fd.time WHERE split = 'val'
GROUP BY ALL)
"""


@query("m10_validate_proxy", VALID + """, a AS (SELECT cluster_id, count(*) AS n_val, median(e) AS m, avg(e) AS me, max(e) AS mx FROM er GROUP BY ALL UNION ALL SELECT -1, count(*),
median(e), avg(e), max(e) FROM er)
SELECT cluster_id, n_val, round(m, 6) AS median_rel_err, round(me, 6) AS mean_rel_err, round(mx, 6) AS max_rel_err,
CASE WHEN m < 1 THEN 'PASS' WHEN m < 2 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM a""")
def _(v):
    return rounded(linear.validate_proxy(_price(v), v.forecast, members.stratified_split(v.members, 0.2, 3)))


@query("f16_proxy_verdict", VALID + "SELECT member_id, CASE WHEN e < 1 THEN 'PASS' WHEN e < 2 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM er")
def _(v):
    errors = linear.proxy_errors(_price(v), v.forecast, members.stratified_split(v.members, 0.2, 3))
    return errors.select("member_id", verdict("error").alias("verdict"))


@query("m10_validate_all_components")
def _(v):
    return linear.validate_proxy(v.theta, v.forecast, members.stratified_split(v.members, 0.2, 3))


@query("m03_singular_values", """
mm AS (SELECT member_id, max(value) FILTER (WHERE time = 1997) AS x, max(value) FILTER (WHERE time = 1998) AS y FROM rates
WHERE metric = 'qty' AND well = 'A' GROUP BY ALL),
c AS (SELECT var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c FROM mm),
e AS (SELECT (a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c ** 2) AS l1, (a + b) / 2 - sqrt(((a - b) / 2) ** 2 + c ** 2) AS l2 FROM c)
SELECT 1::BIGINT AS k, round(sqrt(l1), 5) AS s, round(l1 / (l1 + l2), 7) AS energy, true AS kept FROM e UNION ALL SELECT 2, round(sqrt(l2),
5), 1.0, l1 / (l1 + l2) < 0.9 FROM e""")
def _(v):
    d = v.rates.where("metric = 'qty' and well = 'A' and time in (1997, 1998)")
    return rounded(linear.singular_values(d, 0.9), {"s": 5, "energy": 7})


@query("m03_all_singular_values")
def _(v):
    return linear.singular_values(v.rates, 0.99)


@query("m11_component_rank", """
c3 AS (SELECT member_id, max(value) FILTER (WHERE comp = 'price') AS a, max(value) FILTER (WHERE comp = 'size') AS b FROM theta
GROUP BY ALL),
q3 AS (SELECT count(*) AS n, corr(a, b) AS ab, corr(a, a - 3 * b) AS ac, corr(b, a - 3 * b) AS bc FROM c3)
SELECT CASE WHEN 1 + 2 * ab * ac * bc - ab ** 2 - ac ** 2 - bc ** 2 > 1e-9 THEN 3 WHEN least(ab ** 2, ac ** 2,
bc ** 2) < 1 - 1e-9 THEN 2 ELSE 1 END::BIGINT AS rank, least(n - 1, 3)::BIGINT AS full FROM q3""")
def _(v):
    return linear.component_rank(_mixed(v))


@query("m05_input_violations", """
sp AS (SELECT member_id, kind, metric, CASE WHEN member_id % 5 = 0 AND metric = 'rev' THEN NULL ELSE well END AS well, time,
CASE WHEN member_id % 7 = 0 AND well = 'A' THEN NULL WHEN member_id % 7 = 1 AND well = 'N' THEN 'nan'::DOUBLE ELSE value END AS value
FROM rates),
al AS (SELECT * FROM sp UNION ALL SELECT * FROM sp WHERE member_id % 3 = 0),
ky AS (SELECT count(*) AS n FROM al GROUP BY member_id, kind, metric, well, time)
SELECT count(*) FILTER (WHERE well IS NULL) AS null_keys, count(*) FILTER (WHERE value IS NULL OR isnan(value)) AS bad_values,
(SELECT sum(n - 1)::BIGINT FROM ky) AS repeated_keys FROM al""")
def _(v):
    from tidewell.schemas import violations

    m = F.col("member_id")
    well = F.when((m % 5 == 0) & (F.col("metric") == "rev"), None).otherwise(F.col("well"))
    value = F.when((m % 7 == 0) & (F.col("well") == "A"), None).when((m % 7 == 1) & (F.col("well") == "N"), F.lit(float("nan"))).otherwise(F.col("value"))
    spoilt = v.rates.withColumns({"well": well, "value": value})
    return violations(spoilt.unionByName(spoilt.where("member_id % 3 = 0")), ["member_id", "kind", "metric", "well", "time"], ["value"])


@query("m06_perturbations", """
sg AS (SELECT metric || '|' || well || '|' || time AS pos, greatest(0.15 * abs(d_obs), 0.01 * median(abs(d_obs)) OVER (PARTITION BY metric),
1e-3) AS sigma FROM observed),
dw AS (SELECT member_id, pos, sigma, ('0x' || substr(md5('42-' || member_id || '-' || pos), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
('0x' || substr(md5('43-' || member_id || '-' || pos), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS w FROM members, sg)
SELECT member_id, pos, round(sigma * sqrt(-2 * ln(1 - u)) * cos(2 * pi() * w), 4) AS eps FROM dw""")
def _(v):
    return rounded(linear.perturbation_table(v.members, series.diag_sigma(v.observed)), 4)
