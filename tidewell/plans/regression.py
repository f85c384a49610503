"""Queries on regressions from sums of products: two predictors, whose closed forms outside SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import regression
from tidewell.plans.ensemble import rounded
from tidewell.plans.registry import query

#: Resamples of the queries.
RESAMPLES, SEED = 60, 7

_X = "h + {stride} * (i + 1)".format(stride=regression.STRIDE)
_STEP = [f"x{k + 1} AS (SELECT * EXCLUDE (x), (x * x + {c}) % {regression.PRIME} AS x FROM x{k})" for k, c in enumerate(regression.STEPS)]
_TIMES = " + ".join(f"(x / {regression.PRIME}::DOUBLE >= {float(p)!r})::INT" for p in regression.POISSON)
_FULL = "({w}cay ** 2 * {w}cbb + {w}cby ** 2 * {w}caa - 2 * {w}cay * {w}cby * {w}cab) / (({w}caa * {w}cbb - {w}cab ** 2) * {w}cyy)".format(w="")
_BA, _BB = "((cay * cbb - cby * cab) / (caa * cbb - cab ** 2))", "((cby * caa - cay * cab) / (caa * cbb - cab ** 2))"

MOMENTS = f""",
raw AS (SELECT experiment::VARCHAR AS g, seed * 10 + ascii(well) AS k, net_sand_penetrated AS a, mean_ntg_along_well AS b, kh_penetrated AS y FROM descriptors),
d AS (SELECT g, ('0x' || substr(md5('{SEED}-' || k), 1, 8))::BIGINT % {regression.PRIME} AS h, a - avg(a) OVER () AS a, b - avg(b) OVER () AS b, y - avg(y) OVER () AS y FROM raw),
x0 AS (SELECT g, a, b, y, i, ({_X}) % {regression.PRIME} AS x FROM d, range(0, {RESAMPLES}) r(i)),
{", ".join(_STEP)},
tt AS (SELECT g, i, a, b, y, {_TIMES} AS t FROM x{len(_STEP)}),
s AS (SELECT g, i, sum(t) AS n, sum(t * a) / sum(t) AS ma, sum(t * b) / sum(t) AS mb, sum(t * y) / sum(t) AS my, sum(t * a * a) / sum(t) AS aa, sum(t * b * b) / sum(t) AS bb,
sum(t * y * y) / sum(t) AS yy, sum(t * a * b) / sum(t) AS ab, sum(t * a * y) / sum(t) AS ay, sum(t * b * y) / sum(t) AS byy FROM tt GROUP BY ALL),
c AS (SELECT g, i, n, aa - ma * ma AS caa, bb - mb * mb AS cbb, yy - my * my AS cyy, ab - ma * mb AS cab, ay - ma * my AS cay, byy - mb * my AS cby FROM s),
al AS (SELECT g, count(*) AS n, var_pop(a) AS caa, var_pop(b) AS cbb, var_pop(y) AS cyy, covar_pop(a, b) AS cab, covar_pop(a, y) AS cay, covar_pop(b, y) AS cby FROM d GROUP BY ALL)
"""


@query("m15_uplift_from_sums", MOMENTS.lstrip(",\n") + f""",
tr AS (SELECT g, o, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS caa, var_pop(b) AS cbb, covar_pop(a, b) AS cab, covar_pop(a, y) AS cay, covar_pop(b, y) AS cby FROM d, range(0, 5) r(o)
WHERE h % 5 <> o GROUP BY ALL),
te AS (SELECT d.g, o, 1 - avg((y - my - cay / caa * (a - ma)) ** 2) / var_pop(y) AS e1, 1 - avg((y - my - {_BA} * (a - ma) - {_BB} * (b - mb)) ** 2) / var_pop(y) AS e2 FROM d
JOIN tr ON tr.g = d.g AND tr.o = d.h % 5 GROUP BY ALL),
cv AS (SELECT g, avg(e1) AS r2_base_cv, avg(e2) AS r2_full_cv FROM te GROUP BY ALL),
dr AS (SELECT g, quantile_cont(u, 0.025) AS ci_low, quantile_cont(u, 0.975) AS ci_high FROM (SELECT g, {_FULL} - cay ** 2 / (caa * cyy) AS u FROM c) GROUP BY ALL)
SELECT al.g AS "group", n, round(cay ** 2 / (caa * cyy), 7) AS r2_base, round({_FULL}, 7) AS r2_full, round({_FULL} - cay ** 2 / (caa * cyy), 7) AS uplift, round(ci_low, 7) AS ci_low,
round(ci_high, 7) AS ci_high, round(r2_base_cv, 7) AS r2_base_cv, round(r2_full_cv, 7) AS r2_full_cv, round(r2_full_cv - r2_base_cv, 7) AS uplift_cv FROM al JOIN cv USING (g) JOIN dr USING (g)""")
def _(v):
    d = v.descriptors.withColumn("key", F.col("seed") * 10 + F.ascii("well"))
    return rounded(regression.r2_uplift(d, "experiment", ["net_sand_penetrated"], ["mean_ntg_along_well"], "kh_penetrated", RESAMPLES, SEED, ["key"]), 7)


@query("m16_src2_from_sums", MOMENTS.lstrip(",\n") + f""",
co AS (SELECT g, n, unnest(['net_sand_penetrated', 'mean_ntg_along_well']) AS predictor, unnest([{_BA} * sqrt(caa), {_BB} * sqrt(cbb)]) / (sqrt(cyy * n / (n - 1)) + 1e-12) AS v FROM al),
cd AS (SELECT g, i, unnest(['net_sand_penetrated', 'mean_ntg_along_well']) AS predictor, unnest([{_BA}, {_BB}]) >= 0 AS up FROM c)
SELECT co.g AS "group", co.predictor, n, round(v * v, 7) AS src2, round(avg((up = (v >= 0))::INT), 7) AS stability_fraction FROM co JOIN cd ON cd.g = co.g AND cd.predictor = co.predictor GROUP BY ALL""")
def _(v):
    d = v.descriptors.withColumn("key", F.col("seed") * 10 + F.ascii("well"))
    return rounded(regression.src2(d, "experiment", ["net_sand_penetrated", "mean_ntg_along_well"], "kh_penetrated", RESAMPLES, SEED, ["key"]), 7)
