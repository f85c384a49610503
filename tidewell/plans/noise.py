"""Queries on correlated noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import linear, noise, series
from tidewell.plans.ensemble import TWO, _two, rounded
from tidewell.plans.registry import query

RHO = 0.5


@query("m06_correlated_perturbations", f"""
sg AS (SELECT metric, well, time, metric || '|' || well || '|' || time AS pos, greatest(0.15 * abs(d_obs), 0.01 * median(abs(d_obs)) OVER (PARTITION BY metric), 1e-3) AS sigma FROM observed),
gp AS (SELECT *, time - lag(time) OVER (PARTITION BY metric, well ORDER BY time) AS gap FROM sg),
dw AS (SELECT member_id, g.*, ('0x' || substr(md5('42-' || member_id || '-' || pos), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
('0x' || substr(md5('43-' || member_id || '-' || pos), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS v FROM members, gp g),
zz AS (SELECT member_id, metric, well, time, coalesce(sqrt(1 - {RHO} ** (2 * gap)), 1) * sqrt(-2 * ln(1 - u)) * cos(2 * pi() * v) AS z FROM dw)
SELECT d.member_id, d.pos, round(d.sigma * sum({RHO} ** (d.time - z.time) * z.z), 5) AS eps FROM dw d
JOIN zz z ON z.member_id = d.member_id AND z.metric = d.metric AND z.well = d.well AND z.time <= d.time GROUP BY d.member_id, d.pos, d.sigma""")
def _(v):
    truth = series.diag_sigma(v.observed)
    wanted = v.members.select("member_id").crossJoin(F.broadcast(truth.select(F.concat_ws("|", "metric", "well", F.col("time").cast("string")).alias("pos"))))  # the table of draws is this product
    return rounded(noise.perturbations(wanted, noise.along_time(truth, RHO)), 5)


@query("m04_update_correlated_noise", TWO.replace("covar_samp(d1, d2) AS c FROM", f"covar_samp(d1, d2) + {RHO} * max(s1) * max(s2) AS c FROM"))
def _(v):
    truth = _two(v)
    out = linear.ensemble_update(v.theta, v.rates, truth, energy=1.0, perturb=False, covariance=noise.along_time(truth, RHO))
    return rounded(out.select("member_id", "comp", "value"), 5)
