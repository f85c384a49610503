"""Queries on geology tables, joins and regressions of the virtual ensemble."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions.columns import half_even, sheet_key, status, width_text
from tidewell.operators import geology as geo
from tidewell.operators import geometry, linear, members, nearest, production, quantiles, series, slabs
from tidewell.plans.ensemble import DISTANCE, SHIFT, rounded
from tidewell.plans.registry import query

D4 = geo.DESCRIPTORS
BLOCK = "count(*) AS n, round(avg(value), 3) AS mean, round(CASE WHEN count(value) = 1 THEN 0 ELSE stddev_samp(value) END, 4) AS std, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(max(value) - min(value), 6) AS range"
DIG = {"mean": 3, "std": 4}


@query("a22_spread_block", f"SELECT well, {BLOCK} FROM (SELECT well, kh_penetrated AS value FROM descriptors) GROUP BY ALL")
def _(v):
    return rounded(geo.spread_block(v.descriptors, ["well"], "kh_penetrated"), DIG)


SPREAD = f"""
dl AS (UNPIVOT (SELECT experiment, coalesce(cluster, -1) AS cluster, {", ".join(f"{c}::DOUBLE AS {c}" for c in D4)} FROM descriptors) ON {", ".join(D4)} INTO NAME metric VALUE value),
ds AS (UNPIVOT (SELECT experiment, coalesce(cluster, -1) AS cluster, {", ".join(f"avg({c}) AS {c}" for c in D4)} FROM (SELECT * FROM descriptors) GROUP BY experiment, cluster, seed) ON {", ".join(D4)} INTO NAME metric VALUE value)
"""


@query(
    "a23_descriptor_spread",
    SPREAD + f"SELECT experiment, cluster, metric, 'all_wells' AS scope, {BLOCK} FROM dl GROUP BY ALL UNION ALL SELECT experiment, cluster, metric, 'model_mean', {BLOCK} FROM ds GROUP BY ALL"
)
def _(v):
    return rounded(geo.descriptor_spread(v.descriptors), DIG)


@query(
    "a24_connectivity_spread",
    """
cl AS (UNPIVOT (SELECT experiment, coalesce(cluster, -1) AS cluster, n_bodies_26::DOUBLE AS n_bodies_26, frac_sand_in_largest_26,
top1_n_cells, mean_inj_connections_per_producer FROM connectivity) ON n_bodies_26, frac_sand_in_largest_26, top1_n_cells,
mean_inj_connections_per_producer INTO NAME metric VALUE value) """ + f"SELECT experiment, cluster, metric, {BLOCK} FROM cl GROUP BY ALL"
)
def _(v):
    return rounded(geo.connectivity_spread(v.connectivity), DIG)


@query("a25_width_ratio_text", SPREAD + """,
al AS (SELECT experiment, cluster, metric, CASE WHEN count(value) = 1 THEN 0 ELSE stddev_samp(value) END AS s FROM dl GROUP BY ALL UNION ALL
SELECT experiment, cluster, metric, CASE WHEN count(value) = 1 THEN 0 ELSE stddev_samp(value) END FROM ds GROUP BY ALL),
pv AS (SELECT metric, avg(s) FILTER (WHERE experiment = 1) AS a, avg(s) FILTER (WHERE experiment = 2) AS b FROM al GROUP BY ALL)
SELECT metric, round(a, 4) AS spread_a, round(b, 4) AS spread_b, round(b / nullif(a, 0), 6) AS width_ratio,
CASE WHEN a = 0 THEN '—' WHEN b / a > 1 THEN 'broadens' ELSE 'tightens' END AS interpretation FROM pv""")
def _(v):
    return rounded(geo.geological_width_ratio(geo.descriptor_spread(v.descriptors)), {"spread_a": 4, "spread_b": 4, "width_ratio": 6})


@query(
    "f18_width_text",
    """
SELECT experiment, seed, well, CASE WHEN mean_ntg_along_well / nullif(frac_channel_cells,
0) IS NULL THEN '—' WHEN mean_ntg_along_well / frac_channel_cells > 1 THEN 'broadens' ELSE 'tightens' END AS interpretation FROM descriptors"""
)
def _(v):
    # means of whole hundredths: rounded, equal ones are equal in whatever order they were added
    mean = lambda c: F.round(c, 12)
    return v.descriptors.select("experiment", "seed", "well", width_text(F.try_divide(mean("mean_ntg_along_well"), mean("frac_channel_cells"))).alias("interpretation"))


COMPLY = """
ok AS (SELECT *, dev_field_cum_pct <= 5 AS f1, dev_field_annual_max_pct <= 10 AS f2, dev_well_top80_max_pct <= 20 AS f3,
dev_field_cum_pct <= 5 AND dev_field_annual_max_pct <= 10 AND dev_well_top80_max_pct <= 20 AS f4 FROM setups)"""
N4 = ["pass_field_cum_5pct", "pass_field_annual_10pct", "pass_well_top80_20pct", "pass_all_three"]


@query(
    "a26_compliance_summary",
    COMPLY + " SELECT setup, coalesce(cluster_id, -1) AS cluster, count(*) AS n, " + ", ".join(
        f"count(*) FILTER (WHERE f{i + 1}) AS n_{n}, round(avg(f{i + 1}::INT), 8) AS share_{n}" for i, n in enumerate(N4)
    ) + " FROM ok GROUP BY GROUPING SETS ((setup, cluster_id), (setup))"
)
def _(v):
    return rounded(geo.compliance_summary(geo.compliance(v.setups)), 8)


@query(
    "a27_model_misfit",
    COMPLY + """
 SELECT setup, model_id, cluster_id, round(dev_field_cum_pct + dev_field_annual_max_pct + dev_well_top80_max_pct, 6) AS total_misfit,
f4 AS pass_all_three FROM ok"""
)
def _(v):
    return rounded(geo.model_misfit(geo.compliance(v.setups)))


HISTORY = COMPLY + """,
mm AS (SELECT setup, model_id, cluster_id AS cluster_x, dev_field_cum_pct + dev_field_annual_max_pct + dev_well_top80_max_pct AS total_misfit FROM ok),
latest AS (SELECT * FROM connectivity QUALIFY row_number() OVER (PARTITION BY seed ORDER BY experiment DESC) = 1),
hist AS (SELECT mm.*, l.seed AS s2, l.cluster AS cluster_y, l.n_bodies_26, l.experiment FROM mm LEFT JOIN latest l ON l.seed = mm.model_id)
"""


@query(
    "a28_cross_axis",
    HISTORY + """
SELECT setup, count(*) AS n, round(covar_samp(total_misfit, n_bodies_26) / nullif(stddev_samp(total_misfit) * stddev_samp(n_bodies_26), 0),
7) AS r FROM hist WHERE total_misfit IS NOT NULL AND n_bodies_26 IS NOT NULL GROUP BY ALL HAVING count(*) >= 3"""
)
def _(v):
    h = geo.join_history(geo.model_misfit(geo.compliance(v.setups)), v.connectivity)
    return rounded(geo.cross_axis(h.withColumn("n_bodies_26", F.col("n_bodies_26").cast("double")), "total_misfit", "n_bodies_26", ["setup"]), 7)


BOXES = "bx AS (SELECT cluster_id, comp, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.8) AS hi FROM theta WHERE comp <> 'bal' GROUP BY ALL)"


def _boxes(v):
    q = lambda p: F.percentile("value", F.lit(p))
    return v.theta.where("comp <> 'bal'").groupBy("cluster_id", "comp").agg(q(0.1).alias("lo"), q(0.8).alias("hi"))


@query("a29_conformance", BOXES + """,
j AS (SELECT t.cluster_id, t.comp, t.member_id, value, lo, hi FROM theta t JOIN bx ON bx.cluster_id = t.cluster_id AND bx.comp = t.comp)
SELECT cluster_id, comp, round(lo, 6) AS lo, round(hi, 6) AS hi, round(avg((value BETWEEN lo AND hi)::INT), 8) AS share,
round(median(value), 6) AS median, round(min(value), 6) AS min, round(max(value), 6) AS max FROM j GROUP BY cluster_id, comp, lo, hi
UNION ALL SELECT cluster_id, 'all_three', NULL, NULL, round(avg(ok::INT), 8), NULL, NULL, NULL FROM (SELECT cluster_id, member_id,
bool_and(value BETWEEN lo AND hi) AS ok FROM j GROUP BY ALL) GROUP BY cluster_id""")
def _(v):
    return rounded(geo.conformance(v.theta, _boxes(v)), {"share": 8})


@query(
    "a30_facies_proportions",
    """
SELECT experiment, seed, cluster, round(avg(frac_channel_cells), 8) AS mean_frac_channel, round(avg(mean_ntg_along_well), 8) AS mean_ntg,
count(*) AS n_wells, round(1 - avg(frac_channel_cells), 8) AS mean_frac_background FROM descriptors GROUP BY ALL"""
)
def _(v):
    return rounded(geo.facies_proportions(v.descriptors), 8)


@query(
    "a31_realism",
    "SELECT experiment, cluster, " + ", ".join(
        f"round(median({c}), 6) AS {c}_median, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS {c}_iqr" for c in D4
    ) + " FROM descriptors GROUP BY ALL"
)
def _(v):
    return rounded(geo.realism(v.descriptors, [*D4, "absent"]))


TRAV = "tr AS (SELECT model, 'W' || (i + 4 * j) AS well, i, j, k, 2.0::DOUBLE + k AS dz_eff, (i + k) % 2 = 0 AS perforated FROM cells WHERE (i + j) % 3 = 0)"


def _traversals(v):
    return v.cells.where("(i + j) % 3 = 0").select(
        "model", F.concat(F.lit("W"), (F.col("i") + 4 * F.col("j")).cast("string")).alias("well"), "i", "j", "k",
        (F.lit(2.0) + F.col("k")).alias("dz_eff"), ((F.col("i") + F.col("k")) % 2 == 0).alias("perforated")
    )


@query("a32_well_descriptors", TRAV + """
SELECT t.model, well, count(*) AS n_cells_traversed, count(*) FILTER (WHERE perforated) AS n_cells_perforated,
count(*) FILTER (WHERE ntg = 1 AND permx > 100) AS n_sand_cells, coalesce(sum(dz_eff) FILTER (WHERE ntg = 1 AND permx > 100 AND perforated),
0) AS net_sand_penetrated,
round(coalesce(sum(permx * dz_eff) FILTER (WHERE ntg = 1 AND permx > 100 AND perforated), 0), 6) AS kh_penetrated,
round(avg((ntg = 1 AND permx > 100)::INT), 8) AS frac_channel_cells, round(sum(ntg * dz_eff) / sum(dz_eff), 8) AS mean_ntg_along_well
FROM tr t JOIN cells USING (model, i, j, k) GROUP BY ALL""")
def _(v):
    return rounded(geo.well_descriptors(_traversals(v), v.cells, 100.0), {"frac_channel_cells": 8, "mean_ntg_along_well": 8})


@query(
    "j12_cell_properties",
    TRAV + " SELECT t.model, well, t.k, round(sum(poro), 6) AS poro, count(*) AS n FROM tr t JOIN cells USING (model, i, j, k) GROUP BY ALL"
)
def _(v):
    return rounded(
        _traversals(v).join(v.cells, ["model", "i", "j", "k"]).groupBy("model", "well", "k").agg(
            F.sum("poro").alias("poro"), F.count("*").alias("n")
        )
    )


@query("f12_sand_rule", "SELECT model, flat, ntg = 1 AND permx > 100 AS sand FROM cells")
def _(v):
    return v.cells.select("model", "flat", geo.sand(100.0).alias("sand"))


PERMODEL = """
pm AS (SELECT seed, sum(net_sand_penetrated) AS net, sum(kh_penetrated) AS kh, avg(frac_channel_cells) AS fc,
avg(mean_ntg_along_well) AS ntg FROM descriptors GROUP BY ALL),
c1 AS (SELECT * EXCLUDE (experiment, cluster) FROM connectivity QUALIFY row_number() OVER (PARTITION BY seed ORDER BY experiment) = 1)
"""


@query(
    "a34_descriptors_per_model",
    PERMODEL + """
SELECT pm.seed, net AS net_sand_penetrated, round(kh, 2) AS kh_penetrated, round(fc, 8) AS frac_channel_cells, round(ntg,
8) AS mean_ntg_along_well, n_bodies_26, round(frac_sand_in_largest_26, 8) AS frac_sand_in_largest_26, top1_n_cells,
round(mean_inj_connections_per_producer, 8) AS mean_inj_connections_per_producer FROM pm LEFT JOIN c1 ON c1.seed = pm.seed"""
)
def _(v):
    return rounded(
        geo.descriptors_per_model(v.descriptors, v.connectivity),
        {
            "kh_penetrated": 2, "frac_channel_cells": 8, "mean_ntg_along_well": 8, "frac_sand_in_largest_26": 8,
            "mean_inj_connections_per_producer": 8
        }
    )


RESP = """
resp AS (SELECT member_id, well, sum(value) FILTER (WHERE metric = 'rev') AS o, sum(value) FILTER (WHERE metric = 'disc') AS w
FROM cumulative WHERE time = 2000 GROUP BY ALL)"""


@query(
    "a35_year_end_responses",
    RESP + " SELECT member_id, well, round(o, 2) AS cum_oil, round(CASE WHEN o + w > 0 THEN w / (o + w) END, 8) AS watercut FROM resp"
)
def _(v):
    return rounded(geo.year_end_responses(v.sim, 2000, "rev", "disc"), {"cum_oil": 2, "watercut": 8})


LINKED = PERMODEL + "," + RESP + """,
rm AS (SELECT member_id AS seed, sum(o) AS oil, avg(w / (o + w)) AS cut FROM resp GROUP BY ALL),
lk AS (SELECT pm.*, rm.oil, rm.cut, n_bodies_26::DOUBLE AS bodies, (SELECT count(*) FROM pm) AS nr FROM pm JOIN rm USING (seed) LEFT JOIN c1 USING (seed))
"""


def _linked(v):
    r = geo.year_end_responses(v.sim, 2000, "rev", "disc").groupBy(F.col("member_id").alias("seed")).agg(
        F.sum("cum_oil").alias("oil"), F.avg("watercut").alias("cut")
    )
    return geo.descriptors_per_model(v.descriptors, v.connectivity).join(r, "seed").withColumn("n_bodies_26", F.col("n_bodies_26").cast("double"))


_P = {"net_sand_penetrated": "net", "kh_penetrated": "kh", "n_bodies_26": "bodies"}
PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS predictor, '{y}' AS response, count({b} + {y}) AS n, covar_samp({b}, {y}) / nullif(stddev_samp({b}) * stddev_samp({y}), 0) AS c, 3.0::DOUBLE / sqrt(count(*)) AS t FROM lk" for a,
    b in _P.items() for y in ("oil", "cut")
)


@query(
    "a36_response_correlations",
    LINKED + f", pr AS ({PAIRS}) SELECT predictor, response, n, round(c, 7) AS r, round(t, 8) AS threshold, coalesce(abs(c) > t, false) AS significant FROM pr"
)
def _(v):
    return rounded(geo.response_correlations(_linked(v), list(_P), ["oil", "cut"], ["seed"]), {"r": 7, "threshold": 8})


WELLS = RESP + """
, wl AS (SELECT d.well, d.seed, d.mean_ntg_along_well AS x, o AS y FROM descriptors d
JOIN resp r ON r.member_id = d.seed AND r.well = d.well WHERE d.experiment = 1)"""


def _by_well(v):
    r = geo.year_end_responses(v.sim, 2000, "rev", "disc").withColumnRenamed("member_id", "seed")
    return v.descriptors.where("experiment = 1").join(r, ["seed", "well"])


@query(
    "a37_per_well_correlations",
    WELLS + """
 SELECT well, count(*) AS n, round(covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0), 7) AS r,
round(3.0::DOUBLE / sqrt(count(*)), 8) AS threshold, coalesce(abs(covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y),
0)) > 3.0 / sqrt(count(*)), false) AS significant FROM wl GROUP BY ALL HAVING count(*) >= 3"""
)
def _(v):
    return rounded(geo.per_well_correlations(_by_well(v), "mean_ntg_along_well", "cum_oil"), {"r": 7, "threshold": 8})


@query(
    "a38_cube_difference",
    "SELECT a.model AS seed, " + ", ".join(
        f"round(avg(a.{c}), 8) AS mean_{c}_a, round(avg(b.{c}), 8) AS mean_{c}_b, round(var_pop(a.{c}), 6) AS var_{c}_a, round(var_pop(b.{c}), 6) AS var_{c}_b, round(avg(b.{c}) - avg(a.{c}), 8) AS delta_{c}, round(var_pop(b.{c}) - var_pop(a.{c}), 6) AS delta_var_{c}" for c in (
            "poro", "permx", "ntg"
        )
    ) + ", round(avg((a.ntg = 1)::INT), 8) AS frac_net_a, round(avg((b.ntg = 1)::INT), 8) AS frac_net_b, round(avg((a.ntg <> b.ntg)::INT), 8) AS frac_netflag_changed, round(avg((b.ntg = 1)::INT) - avg((a.ntg = 1)::INT), 8) AS delta_frac_net FROM cells a JOIN cells b ON b.model = a.model + 1 AND b.flat = a.flat WHERE a.model % 2 = 0 GROUP BY a.model"
)
def _(v):
    pairs = v.cells.where("model % 2 = 0").select(
        F.col("model").alias("seed"), F.col("model").alias("model_a"), (F.col("model") + 1).alias("model_b")
    ).distinct()
    out = geo.cube_difference(v.cells, v.cells, pairs)
    return rounded(out, {c: 6 if "var_" in c else 8 for c in out.columns})


DECKS = "dk AS (SELECT (s_suppkey % 7) AS seed, s_nationkey % 2 = 0 AS centroid, s_name AS directory, s_nationkey % 3 AS ex FROM supplier)"


def _decks(v):
    s = v.table("supplier")
    return s.select(
        (F.col("s_suppkey") % 7).alias("seed"), (F.col("s_nationkey") % 2 == 0).alias("centroid"), F.col("s_name").alias("directory"),
        (F.col("s_nationkey") % 3).alias("ex")
    )


@query(
    "j09_matched_seeds",
    DECKS + """
 SELECT a.seed, a.d AS directory_a, b.d AS directory_b FROM (SELECT seed, max(directory) AS d FROM dk WHERE ex = 0 AND NOT centroid
GROUP BY ALL) a JOIN (SELECT seed, max(directory) AS d FROM dk WHERE ex = 1 AND NOT centroid GROUP BY ALL) b USING (seed)"""
)
def _(v):
    d = _decks(v)
    return geo.matched_seeds(d.where("ex = 0"), d.where("ex = 1"))


@query("a39_model_index", """
fl AS (SELECT s_name AS directory, kind FROM supplier, (VALUES ('grid', 2), ('poro', 3), ('permx', 5), ('ntg', 7), ('schedule', 11), ('satnum', 13), ('tracks', 4), ('results', 6)) k(kind,
m) WHERE s_suppkey % m = 0),
wl AS (SELECT s_name AS directory, l_returnflag AS well FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_suppkey % 4 > 0)
SELECT s_name AS directory, """ + ", ".join(f"coalesce(max((kind = '{k}')::INT), 0) AS has_{k}" for k in ("grid", "poro", "permx", "ntg", "schedule", "satnum", "tracks", "results")) + """
, (SELECT count(DISTINCT well) FROM wl WHERE wl.directory = s_name) AS n_wells FROM supplier LEFT JOIN fl ON fl.directory = s_name
GROUP BY s_name""")
def _(v):
    s = v.table("supplier").select("s_suppkey", F.col("s_name").alias("directory"))
    k = F.explode(
        F.array(
            *(
                F.struct(F.lit(n).alias("kind"), F.lit(m).alias("m")) for n,
                m in (("grid", 2), ("poro", 3), ("permx", 5), ("ntg", 7), ("schedule", 11), ("satnum", 13), ("tracks", 4), ("results", 6))
            )
        )
    )
    files = s.withColumn("k", k).where("s_suppkey % k.m = 0").select("directory", "k.kind")
    line = v.table("lineitem").where("l_suppkey % 4 > 0")
    wells = line.join(s, line.l_suppkey == s.s_suppkey).select("directory", F.col("l_returnflag").alias("well"))
    return geo.model_index(s.select("directory"), files, wells)


def _mask(v):
    return v.cells.where(geo.sand(100.0))


NEIGH = """
sd AS (SELECT model, flat, i, j, k FROM cells WHERE ntg = 1 AND permx > 100),
walk AS (SELECT model, flat, flat AS root FROM sd UNION SELECT w.model, b.flat, w.root FROM walk w
JOIN sd a ON a.model = w.model AND a.flat = w.flat JOIN sd b ON b.model = a.model AND {near}),
lowest AS (SELECT model, flat, min(root) AS root FROM walk GROUP BY ALL),
lab AS (SELECT model, flat, dense_rank() OVER (PARTITION BY model ORDER BY root) AS body FROM lowest)
"""
NEAR26 = "abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1"
NEAR6 = "abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1"
LAB26, LAB6 = NEIGH.format(near=NEAR26), NEIGH.format(near=NEAR6)


@query("m19_label_bodies_26", LAB26 + "SELECT model, flat, body FROM lab")
def _(v):
    return geometry.label_bodies(_mask(v), 26).select("model", "flat", "body")


@query("m19_label_bodies_6", LAB6 + "SELECT model, flat, body FROM lab")
def _(v):
    return geometry.label_bodies(_mask(v), 6).select("model", "flat", "body")


@query("m19_label_bodies_by_blocks_26", LAB26 + "SELECT model, flat, body FROM lab")
def _(v):
    return slabs.label_bodies_blocks(_mask(v), 26, (2, 3, 2))


@query("m19_label_bodies_by_blocks_6", LAB6 + "SELECT model, flat, body FROM lab")
def _(v):
    return slabs.label_bodies_blocks(_mask(v), 6, (3, 2, 1))


STATS = LAB6 + """,
full_lab AS (SELECT lab.*, i, j, k FROM lab JOIN sd USING (model, flat)),
bs AS (SELECT model, body, count(*) AS n_cells, (max(i) - min(i) + 1)::BIGINT AS ei, (max(j) - min(j) + 1)::BIGINT AS ej,
(max(k) - min(k) + 1)::BIGINT AS ek, coalesce(var_samp(i), 0) AS a, coalesce(var_samp(j), 0) AS c, coalesce(covar_samp(i, j), 0) AS b
FROM full_lab GROUP BY ALL),
bt AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY n_cells DESC, body) AS rank, (a + c) / 2 AS mid,
sqrt(((a - c) / 2) ** 2 + b ** 2) AS root, degrees(0.5 * atan2(2 * b, a - c)) AS ang FROM bs)
"""


@query(
    "a40_body_stats",
    STATS + """
SELECT model, body, n_cells, ei AS extent_i, ej AS extent_j, ek AS extent_k, round(greatest(ei, ej, ek) / least(ei, ej, ek),
8) AS anisotropy, rank, round(CASE WHEN n_cells >= 2 THEN 2 * sqrt(greatest(mid + root, 0)) ELSE 0 END, 6) AS major FROM bt WHERE rank <= 5"""
)
def _(v):
    s = geometry.body_stats(geometry.label_bodies(_mask(v), 6), 5)
    return rounded(
        s.select(
            "model", "body", "n_cells", "extent_i", "extent_j", "extent_k", "anisotropy", F.col("rank").cast("long").alias("rank"), "major"
        ),
        {"anisotropy": 8}
    )


@query(
    "m09_principal_axes",
    """
SELECT cluster AS c, round(2 * sqrt(greatest(m + r, 0)), 3) AS major, round(2 * sqrt(greatest(m - r, 0)), 3) AS minor,
round(CASE WHEN g <= -90 THEN 90 ELSE g END, 6) AS angle FROM (SELECT cluster, (a + c) / 2 AS m, sqrt(((a - c) / 2) ** 2 + b ** 2) AS r,
degrees(0.5 * atan2(2 * b, a - c)) AS g FROM (SELECT cluster, var_samp(net_sand_penetrated) AS a, var_samp(kh_penetrated / 1000) AS c,
covar_samp(net_sand_penetrated, kh_penetrated / 1000) AS b FROM descriptors GROUP BY ALL))"""
)
def _(v):
    d = v.descriptors.select(F.col("cluster").alias("c"), F.col("net_sand_penetrated").alias("x"), (F.col("kh_penetrated") / 1000).alias("y"))
    return rounded(geometry.principal_axes(d.withColumnRenamed("c", "c_"), ["c_"]).withColumnRenamed("c_", "c"), {"major": 3, "minor": 3, "angle": 6})


@query(
    "a42_sand_fractions",
    STATS + """
SELECT model, count(*) AS n_bodies, round(sum(n_cells) FILTER (WHERE rank = 1) / sum(n_cells), 8) AS frac_largest,
round(sum(n_cells) FILTER (WHERE rank <= 10) / sum(n_cells), 8) AS frac_top10 FROM bt GROUP BY ALL"""
)
def _(v):
    return rounded(geometry.sand_fractions(geometry.body_stats(geometry.label_bodies(_mask(v), 6))), 8)


WP = LAB6 + """,
wc AS (SELECT model, CASE WHEN (i + j) % 2 = 0 THEN 'INJ' ELSE 'WELL' END || (i + 4 * j) AS well, i, j, k FROM cells WHERE (i + j) % 3 = 0),
hits AS (SELECT DISTINCT wc.model, wc.well, lab.body FROM wc JOIN sd ON sd.model = wc.model AND sd.i = wc.i AND sd.j = wc.j AND sd.k = wc.k
JOIN lab ON lab.model = sd.model AND lab.flat = sd.flat),
wp AS (SELECT DISTINCT x.model, x.well AS a, y.well AS b FROM hits x
JOIN hits y ON x.model = y.model AND x.body = y.body AND x.well < y.well)
"""


def _well_cells(v):
    name = F.concat(F.when((F.col("i") + F.col("j")) % 2 == 0, "INJ").otherwise("WELL"), (F.col("i") + 4 * F.col("j")).cast("string"))
    return v.cells.where("(i + j) % 3 = 0").select("model", name.alias("well"), "i", "j", "k")


@query("j15_well_pairs", WP + "SELECT model, a, b FROM wp")
def _(v):
    return geometry.well_pairs(_well_cells(v), geometry.label_bodies(_mask(v), 6))


@query("u04_shared_bodies", WP + "SELECT model, count(*) AS pairs FROM wp GROUP BY ALL")
def _(v):
    w = _well_cells(v).join(geometry.label_bodies(_mask(v), 6), ["model", "i", "j", "k"]).groupBy("model", "well").agg(F.collect_set("body").alias("s"))
    a, b = w.select("model", F.col("well").alias("a"), F.col("s").alias("sa")), w.select("model", F.col("well").alias("b"), F.col("s").alias("sb"))
    return a.join(b, "model").where(F.arrays_overlap("sa", "sb") & (F.col("a") < F.col("b"))).groupBy("model").agg(F.count("*").alias("pairs"))


@query("a41_injector_connections", WP + """,
ws AS (SELECT DISTINCT model, well FROM wc), bi AS (SELECT model, a, b FROM wp UNION ALL SELECT model, b, a FROM wp),
cn AS (SELECT ws.model, ws.well, count(bi.b) FILTER (WHERE bi.b LIKE 'INJ%') AS n FROM ws LEFT
JOIN bi ON bi.model = ws.model AND bi.a = ws.well WHERE ws.well NOT LIKE 'INJ%' GROUP BY ALL)
SELECT cn.model, count(*) AS n_producers, round(avg(n), 8) AS mean_connections, max(n) AS max_connections,
count(*) FILTER (WHERE n > 0) AS n_connected, any_value(ni) AS n_injectors FROM cn JOIN (SELECT model, count(*) AS ni FROM ws
WHERE well LIKE 'INJ%' GROUP BY ALL) x ON x.model = cn.model GROUP BY cn.model""")
def _(v):
    w = _well_cells(v)
    return rounded(geometry.injector_connections(w, geometry.well_pairs(w, geometry.label_bodies(_mask(v), 6))), 8)


@query("m18_perm_cutoff", """
ps AS (SELECT l_suppkey % 5 AS model, l_extendedprice / 1000 AS permx FROM lineitem),
po AS (SELECT model, permx, log10(permx) AS lp FROM ps WHERE permx > 0),
st AS (SELECT model, count(*) AS n, min(lp) AS lo, max(lp) AS hi, quantile_cont(permx, 0.99) AS top FROM po GROUP BY ALL),
hc AS (SELECT po.model, least(floor((lp - lo) / (hi - lo) * 80) + 1, 80)::INT AS bin, count(*) AS c FROM po JOIN st ON st.model = po.model
GROUP BY ALL),
fb AS (SELECT st.model, b.bin, coalesce(c, 0) AS c FROM st CROSS JOIN range(1, 81) b(bin) LEFT
JOIN hc ON hc.model = st.model AND hc.bin = b.bin),
sm AS (SELECT model, bin, (coalesce(lag(c, 2) OVER w, 0) + 3 * coalesce(lag(c, 1) OVER w, 0) + 5 * c + 3 * coalesce(lead(c, 1) OVER w,
0) + coalesce(lead(c, 2) OVER w, 0)) / 13.0::DOUBLE AS s FROM fb WINDOW w AS (PARTITION BY model ORDER BY bin)),
pk AS (SELECT * FROM (SELECT *, lag(s) OVER w AS p, lead(s) OVER w AS q FROM sm WINDOW w AS (PARTITION BY model ORDER BY bin))
WHERE s >= p AND s >= q),
tw AS (SELECT model, min(bin) AS a, max(bin) AS b FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY s DESC, bin) AS r FROM pk)
WHERE r <= 2 GROUP BY ALL HAVING count(*) = 2),
tg AS (SELECT model, bin AS t FROM sm JOIN tw USING (model) WHERE bin BETWEEN a AND b QUALIFY row_number() OVER (PARTITION BY model
ORDER BY s, bin) = 1)
SELECT st.model, round(CASE WHEN n >= 100 AND pow(10, lo + (hi - lo) * t / 80) <= top THEN pow(10, lo + (hi - lo) * t / 80) ELSE 0 END,
6) AS cutoff FROM st LEFT JOIN tg USING (model)""")
def _(v):
    c = v.table("lineitem").select((F.col("l_suppkey") % 5).alias("model"), (F.col("l_extendedprice") / 1000).alias("permx"))
    return rounded(geometry.perm_cutoff(c, ["model"]))


@query(
    "t08_runs",
    """
r AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS NOT DISTINCT
FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id
ORDER BY event_id)), s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM r) SELECT user_id, run::BIGINT AS run,
event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM s WHERE event_type IS NOT NULL GROUP BY ALL"""
)
def _(v):
    return geometry.runs(v.table("events"), ["user_id"], ["event_id"], "event_type").withColumn("run", F.col("run").cast("long"))


TRACK = """
tk AS (SELECT p_partkey % 4 AS model, 'W' || (p_partkey // 40) AS well, (p_partkey // 4) % 10 AS seq,
5.0::DOUBLE + ((p_partkey // 4) % 10) * (3 + p_partkey % 4) AS x, 4.0::DOUBLE + ((p_partkey // 4) % 10) * 2.5 AS y,
1.0::DOUBLE + ((p_partkey // 4) % 10) * 3.0 AS z, ((p_partkey // 4) % 10) * 5.0::DOUBLE AS md FROM part),
bx AS (SELECT model, well, min_by(md, seq) AS a, max_by(md, seq) AS b, count(*) AS m FROM tk GROUP BY ALL
HAVING count(*) >= 2 AND max_by(md, seq) > min_by(md, seq)),
pt AS (SELECT model, well, s, CASE WHEN s = n - 1 THEN b ELSE a + (b - a) * s / (n - 1) END AS q_md FROM (SELECT *, greatest(2,
ceil((b - a) / 0.5) + 1)::INT AS n FROM bx) q, range(0, 2000) r(s) WHERE s < n),
sg AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2, lead(md) OVER w AS md2
FROM tk WINDOW w AS (PARTITION BY model, well ORDER BY seq)),
sp AS (SELECT pt.model, pt.well, s, q_md AS md, x + (x2 - x) * (q_md - md) / (md2 - md) AS x, y + (y2 - y) * (q_md - md) / (md2 - md) AS y,
z + (z2 - z) * (q_md - md) / (md2 - md) AS z FROM pt JOIN sg ON sg.model = pt.model AND sg.well = pt.well AND q_md >= md AND q_md <= md2
QUALIFY row_number() OVER (PARTITION BY pt.model, pt.well, s ORDER BY seq) = 1)
"""


def _tracks(v):
    k = F.col("p_partkey")
    seq = F.floor(k / 4) % 10
    return v.table("part").select(
        (k % 4).alias("model"), F.concat(F.lit("W"), F.floor(k / 40).cast("string")).alias("well"), seq.alias("seq"),
        (5.0 + seq * (3 + k % 4)).alias("x"), (4.0 + seq * 2.5).alias("y"), (1.0 + seq * 3.0).alias("z"),
        (seq * 5.0).cast("double").alias("md")
    )


@query("m21_sample_track", TRACK + "SELECT model, well, s, round(md, 6) AS md, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM sp")
def _(v):
    return rounded(geometry.sample_track(_tracks(v)).withColumn("s", F.col("s").cast("long")))


PILLAR = """
pl AS (SELECT c_custkey % 40 AS i, c_custkey // 40 AS j, (c_custkey % 40) * 10.0::DOUBLE + c_custkey // 40 AS x,
(c_custkey // 40) * 8.0::DOUBLE + 0.5 * (c_custkey % 40) AS y FROM customer)"""


def _pillars(v):
    key = F.col("c_custkey")
    return v.table("customer").select((key % 40).cast("int").alias("i"), F.floor(key / 40).cast("int").alias("j")).select(
        "i", "j", (F.col("i") * 10.0 + F.col("j")).alias("x"), (F.col("j") * 8.0 + 0.5 * F.col("i")).alias("y")
    )


def _layers(v):
    return geometry.grid_quads(_pillars(v)).select("i", "j").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(
        "i", "j", "k", (F.col("k") * 6.0 + F.col("i")).alias("z_top"), (F.col("k") * 6.0 + 6.0 + F.col("i")).alias("z_bot")
    )


@query(
    "m20_grid_index",
    PILLAR + """
 SELECT a.i::INT AS i, a.j::INT AS j, round((a.x + b.x + c.x + d.x) / 4, 6) AS cx, round((a.y + b.y + c.y + d.y) / 4, 6) AS cy FROM pl a
JOIN pl b ON b.i = a.i + 1 AND b.j = a.j JOIN pl c ON c.i = a.i + 1 AND c.j = a.j + 1 JOIN pl d ON d.i = a.i AND d.j = a.j + 1"""
)
def _(v):
    return rounded(geometry.grid_quads(_pillars(v)).select("i", "j", "cx", "cy"))


LOCATE = TRACK + "," + PILLAR + """,
qd AS (SELECT a.i, a.j, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, c.x AS x2, c.y AS y2, d.x AS x3, d.y AS y3 FROM pl a
JOIN pl b ON b.i = a.i + 1 AND b.j = a.j JOIN pl c ON c.i = a.i + 1 AND c.j = a.j + 1 JOIN pl d ON d.i = a.i AND d.j = a.j + 1),
cr AS (SELECT model, well, s, i, j, (x - (x0 + x1 + x2 + x3) / 4) ** 2 + (y - (y0 + y1 + y2 + y3) / 4) ** 2 AS dist,
[(x1 - x0) * (y - y0) - (y1 - y0) * (x - x0), (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1), (x3 - x2) * (y - y2) - (y3 - y2) * (x - x2),
(x0 - x3) * (y - y3) - (y0 - y3) * (x - x3)] AS c FROM sp JOIN qd ON x >= least(x0, x1, x2, x3) AND x <= greatest(x0, x1, x2,
x3) AND y >= least(y0, y1, y2, y3) AND y <= greatest(y0, y1, y2, y3)),
ij AS (SELECT model, well, s, i, j FROM cr WHERE list_min(c) >= 0 OR list_max(c) <= 0 QUALIFY row_number() OVER (PARTITION BY model, well, s
ORDER BY dist, j, i) = 1),
att AS (SELECT sp.*, ij.i, ij.j FROM sp LEFT JOIN ij USING (model, well, s)),
kb AS (SELECT att.*, (SELECT min(k) FROM range(0, 5) r(k) WHERE z >= k * 6.0 + i AND z <= k * 6.0 + 6 + i) AS k FROM att)
"""


@query("j13_locate", LOCATE + "SELECT model, well, s, i::INT AS i, j::INT AS j FROM att")
def _(v):
    return geometry.locate(
        geometry.sample_track(_tracks(v)), geometry.grid_quads(_pillars(v)).drop("cx", "cy"), 12.0
    ).select("model", "well", F.col("s").cast("long").alias("s"), "i", "j")


@query("j13_locate_nearest", LOCATE + "SELECT model, well, s, i::INT AS i, j::INT AS j FROM att")
def _(v):
    return nearest.locate_nearest(geometry.sample_track(_tracks(v)), geometry.grid_quads(_pillars(v)).drop("cx", "cy")).select(
        "model", "well", F.col("s").cast("long").alias("s"), "i", "j"
    )


@query("j14_bracket", LOCATE + "SELECT model, well, s, k::INT AS k FROM kb")
def _(v):
    p = geometry.locate(geometry.sample_track(_tracks(v)), geometry.grid_quads(_pillars(v)).drop("cx", "cy"), 12.0)
    return geometry.bracket(p, _layers(v)).select("model", "well", F.col("s").cast("long").alias("s"), "k")


PERFS = LOCATE + """,
ch AS (SELECT *, CASE WHEN k IS NULL THEN NULL ELSE i || '-' || j || '-' || k END AS cell FROM kb),
rn AS (SELECT *, CASE WHEN cell IS NOT DISTINCT FROM lag(cell) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c
FROM ch WINDOW w AS (PARTITION BY model, well ORDER BY s)),
rr AS (SELECT *, sum(c) OVER (PARTITION BY model, well ORDER BY s) AS run FROM rn),
tv AS (SELECT model, well, run::BIGINT AS run, i::INT AS i, j::INT AS j, k::INT AS k, min(md) AS md_in, max(md) AS md_out, abs(max_by(z,
s) - min_by(z, s)) AS dz_eff FROM rr WHERE cell IS NOT NULL GROUP BY ALL),
pf AS (SELECT model, well, 8.0::DOUBLE AS md_low, 21.0::DOUBLE AS md_high FROM (SELECT DISTINCT model, well FROM tk WHERE model < 3))
"""


def _perfs(v):
    return _tracks(v).where("model < 3").select("model", "well").distinct().select("model", "well", F.lit(8.0).alias("md_low"), F.lit(21.0).alias("md_high"))


@query(
    "m22_traverse_wells",
    PERFS + """
SELECT model, well, run, i, j, k, round(md_in, 6) AS md_in, round(md_out, 6) AS md_out, round(dz_eff, 6) AS dz_eff,
model >= 3 OR greatest(least(md_in, md_out), 8) + 1e-6 < least(greatest(md_in, md_out), 21) AS perforated FROM tv"""
)
def _(v):
    t = geometry.traverse(_tracks(v), geometry.grid_quads(_pillars(v)).drop("cx", "cy"), _layers(v), _perfs(v), 0.5, 12.0)
    return rounded(t.withColumn("run", F.col("run").cast("long")))


@query(
    "j11_perforation_overlap",
    """
sp AS (SELECT l_suppkey AS model, l_returnflag AS well, l_orderkey AS o, min(l_quantity) AS md_in, max(l_quantity) + 3 AS md_out
FROM lineitem GROUP BY ALL), pf AS (SELECT s_suppkey AS model, 'A' AS well, 10.0::DOUBLE AS lo, 20.0::DOUBLE AS hi FROM supplier UNION ALL
SELECT s_suppkey, 'N', 30, 35 FROM supplier WHERE s_suppkey % 2 = 0) SELECT sp.model, sp.well, o, md_in, md_out,
bool_or(lo IS NULL OR greatest(md_in, lo) + 1e-6 < least(md_out, hi)) AS perforated FROM sp LEFT
JOIN pf ON pf.model = sp.model AND pf.well = sp.well GROUP BY ALL"""
)
def _(v):
    sp = v.table("lineitem").groupBy(
        F.col("l_suppkey").alias("model"), F.col("l_returnflag").alias("well"), F.col("l_orderkey").alias("o")
    ).agg(F.min("l_quantity").alias("md_in"), (F.max("l_quantity") + 3).alias("md_out"))
    s = v.table("supplier").select(F.col("s_suppkey").alias("model"))
    pf = s.select(
        "model", F.lit("A").alias("well"), F.lit(10.0).alias("md_low"), F.lit(20.0).alias("md_high")
    ).union(s.where("model % 2 = 0").select("model", F.lit("N"), F.lit(30.0), F.lit(35.0)))
    return geometry.perforated(sp, pf)


@query(
    "t11_smoothing",
    """
h AS (SELECT p_size::INT AS bin, count(*) AS c FROM part GROUP BY ALL) SELECT bin, round((coalesce(lag(c, 2) OVER w,
0) + 3 * coalesce(lag(c, 1) OVER w, 0) + 5 * c + 3 * coalesce(lead(c, 1) OVER w, 0) + coalesce(lead(c, 2) OVER w, 0)) / 13.0::DOUBLE,
6) AS smooth FROM h WINDOW w AS (ORDER BY bin)"""
)
def _(v):
    w = Window.orderBy("bin")
    h = v.table("part").groupBy(F.col("p_size").cast("int").alias("bin")).agg(F.count("*").alias("c"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return rounded(
        h.select(
            "bin",
            (
                (
                    z(F.lag("c", 2).over(w)) + 3 * z(F.lag("c").over(w)) + 5 * F.col("c") + 3 * z(F.lead("c").over(w)) + z(
                        F.lead("c", 2).over(w)
                    )
                ) / 13.0
            ).alias("smooth")
        )
    )


@query(
    "t12_local_maxima",
    """
h AS (SELECT p_size::INT AS bin, count(*) AS c FROM part GROUP BY ALL), n AS (SELECT *, lag(c) OVER w AS p, lead(c) OVER w AS q
FROM h WINDOW w AS (ORDER BY bin)) SELECT bin, c FROM n WHERE c >= p AND c >= q ORDER BY c DESC, bin LIMIT 2"""
)
def _(v):
    w = Window.orderBy("bin")
    h = v.table("part").groupBy(F.col("p_size").cast("int").alias("bin")).agg(F.count("*").alias("c"))
    n = h.withColumn("p", F.lag("c").over(w)).withColumn("q", F.lead("c").over(w)).where("c >= p and c >= q")
    return n.orderBy(F.desc("c"), "bin").limit(2).select("bin", "c")


@query(
    "t09_a47_energy",
    """
sv AS (SELECT row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS k, abs(s_acctbal) AS s FROM supplier), e AS (SELECT k, s,
sum(s * s) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) / (SELECT sum(s * s) FROM sv) AS energy FROM sv) SELECT k, round(s, 6) AS s,
round(energy, 8) AS energy, (SELECT min(k) FROM e WHERE energy >= 0.9) AS r FROM e"""
)
def _(v):
    s = v.table("supplier").select(F.row_number().over(Window.orderBy(F.desc("s_acctbal"), "s_suppkey")).cast("long").alias("k"), F.abs("s_acctbal").alias("s"))
    return rounded(geo.energy(s, 0.9), {"energy": 8})


@query(
    "t10_latest_per_seed",
    "SELECT seed, experiment, n_bodies_26 FROM connectivity QUALIFY row_number() OVER (PARTITION BY seed ORDER BY experiment DESC) = 1"
)
def _(v):
    return geo.first_rows(v.connectivity, ["seed"], [F.desc("experiment")]).select("seed", "experiment", "n_bodies_26")


@query(
    "t05_sorted_misfit",
    "g AS (SELECT well, abs(avg(value)) AS m FROM rates GROUP BY ALL) SELECT well, row_number() OVER (ORDER BY round(m, 3) DESC, well) AS pos FROM g"
)
def _(v):
    g = v.rates.groupBy("well").agg(F.round(F.abs(F.avg("value")), 3).alias("m"))
    return g.select("well", F.row_number().over(Window.orderBy(F.desc("m"), "well")).cast("long").alias("pos"))


@query(
    "t06_order_statistics",
    """
SELECT metric, member_id, row_number() OVER (PARTITION BY metric ORDER BY value, member_id) AS k, count(*) OVER (PARTITION BY metric) AS m
FROM rates WHERE well = 'A' AND time = 1997"""
)
def _(v):
    w = Window.partitionBy("metric")
    # sums of whole ten-thousandths: rounded, equal ones are equal in whatever order they were added, and the member decides
    return v.rates.where("well = 'A' and time = 1997").select(
        "metric", "member_id", F.row_number().over(w.orderBy(F.round("value", 4), "member_id")).cast("long").alias("k"), F.count("*").over(w).alias("m")
    )


@query("t07_first_appearance", "SELECT model_id, min(ord) AS first_ord, dense_rank() OVER (ORDER BY min(ord)) AS place FROM members GROUP BY ALL")
def _(v):
    g = v.members.groupBy("model_id").agg(F.min("ord").alias("first_ord"))
    return g.withColumn("place", F.dense_rank().over(Window.orderBy("first_ord")).cast("long"))


AX = """
ax AS (SELECT axis, metric, scope, a::DOUBLE AS value_old, b::DOUBLE AS value_new, direction FROM ({rows})) SELECT axis, metric, scope,
round(value_old, 6) AS value_old, round(value_new, 6) AS value_new, direction,
CASE WHEN direction = '~' OR value_old IS NULL OR value_new IS NULL OR abs(value_new - value_old) < greatest(1e-9,
1e-3 * greatest(abs(value_old),
abs(value_new))) THEN 'NEUTRAL' WHEN direction = '>' AND value_new > value_old OR direction = '<' AND value_new < value_old THEN 'BETTER' ELSE 'WORSE' END AS status,
round(value_new - value_old, 6) AS delta, round(value_new / nullif(value_old, 0), 6) AS ratio FROM ax"""


def _axrow(axis, metric, agg, direction, table):
    return f"SELECT '{axis}' AS axis, '{metric}' AS metric, 'all' AS scope, (SELECT {agg} FROM {table} WHERE experiment = 1) AS a, (SELECT {agg} FROM {table} WHERE experiment = 2) AS b, '{direction}' AS direction"


@query(
    "a43_axis_connectivity",
    AX.format(
        rows=" UNION ALL ".join(
            [
                _axrow("connectivity", "mean_bodies", "avg(n_bodies_26)", "<", "connectivity"),
                _axrow("connectivity", "median_largest", "median(frac_sand_in_largest_26)", ">", "connectivity"),
                _axrow("connectivity", "min_injectors", "min(mean_inj_connections_per_producer)", "~", "connectivity")
            ]
        )
    )
)
def _(v):
    out = geo.axis_means(
        v.connectivity, "connectivity",
        {
            "mean_bodies": (F.avg("n_bodies_26"), "<"), "median_largest": (F.median("frac_sand_in_largest_26"), ">"),
            "min_injectors": (F.min("mean_inj_connections_per_producer"), "~")
        }
    )
    return rounded(out)


@query(
    "a43_axis_descriptors",
    AX.format(
        rows=" UNION ALL ".join(
            [
                _axrow("descriptors", "mean_kh", "avg(kh_penetrated)", ">", "descriptors"),
                _axrow("descriptors", "thin_wells", "count(*) FILTER (WHERE net_sand_penetrated < 100)", "<", "descriptors"),
                _axrow("descriptors", "median_ntg", "median(mean_ntg_along_well)", ">", "descriptors")
            ]
        )
    )
)
def _(v):
    out = geo.axis_means(
        v.descriptors, "descriptors",
        {
            "mean_kh": (F.avg("kh_penetrated"), ">"), "thin_wells": (F.count_if(F.col("net_sand_penetrated") < 100), "<"),
            "median_ntg": (F.median("mean_ntg_along_well"), ">")
        }
    )
    return rounded(out)


@query(
    "a43_axis_clusters",
    AX.format(
        rows="""
SELECT 'diversity' AS axis, 'mean_net' AS metric, 'cluster_' || cluster AS scope,
avg(net_sand_penetrated) FILTER (WHERE experiment = 1) AS a, avg(net_sand_penetrated) FILTER (WHERE experiment = 2) AS b, '<' AS direction
FROM descriptors GROUP BY cluster"""
    )
)
def _(v):
    return rounded(geo.axis_by_cluster(v.descriptors, "diversity", "mean_net", "net_sand_penetrated", "<"))


@query(
    "a43_axis_rebuild",
    """
x AS (SELECT a.model, avg((a.ntg <> b.ntg)::INT) AS nf, abs(avg(b.poro) - avg(a.poro)) AS dp, abs(avg(b.permx) - avg(a.permx)) AS dk, abs(avg(b.ntg) - avg(a.ntg)) AS dn
FROM cells a JOIN cells b ON b.model = a.model + 1 AND b.flat = a.flat WHERE a.model % 2 = 0 GROUP BY a.model),
""" + AX.lstrip().format(
        rows=" UNION ALL ".join(
            f"SELECT 'rebuild' AS axis, '{m}' AS metric, 'matched_seeds' AS scope, 0.0 AS a, (SELECT avg({c}) FROM x) AS b, '~' AS direction"
            for m, c in (("frac_netflag_changed", "nf"), ("abs_delta_poro", "dp"), ("abs_delta_permx", "dk"), ("abs_delta_ntg", "dn"))
        )
    )
)
def _(v):
    pairs = v.cells.where("model % 2 = 0").select(F.col("model").alias("seed"), F.col("model").alias("model_a"), (F.col("model") + 1).alias("model_b")).distinct()
    return rounded(geo.axis_rebuild(geo.cube_difference(v.cells, v.cells, pairs)))


@query(
    "a43_axis_misfit",
    AX.format(
        rows="""
SELECT 'history' AS axis, 'mean_total_misfit' AS metric, 'cluster_' || cluster_id AS scope,
avg(dev_field_cum_pct + dev_field_annual_max_pct + dev_well_top80_max_pct) FILTER (WHERE setup = 'setup1') AS a,
avg(dev_field_cum_pct + dev_field_annual_max_pct + dev_well_top80_max_pct) FILTER (WHERE setup = 'setup2') AS b, '<' AS direction FROM setups GROUP BY cluster_id"""
    )
)
def _(v):
    return rounded(geo.axis_misfit(geo.model_misfit(geo.compliance(v.setups)), "setup1", "setup2"))


@query("a43_summary_comparison", COMPLY + "," + PERMODEL + "," + RESP + """,
rm AS (SELECT member_id AS seed, sum(o) AS oil, avg(w / (o + w)) AS cut FROM resp GROUP BY ALL),
lk AS (SELECT pm.*, rm.oil, rm.cut, n_bodies_26::DOUBLE AS bodies FROM pm JOIN rm USING (seed) LEFT JOIN c1 USING (seed)),
pr AS (""" + PAIRS + """),
sh AS (SELECT metric, setup, v FROM (UNPIVOT (SELECT setup, avg(f1::INT) AS share_pass_field_cum_5pct,
avg(f2::INT) AS share_pass_field_annual_10pct, avg(f3::INT) AS share_pass_well_top80_20pct, avg(f4::INT) AS share_pass_all_three FROM ok
GROUP BY setup) ON COLUMNS(* EXCLUDE (setup)) INTO NAME metric VALUE v)),
ho AS (SELECT metric, max(v) FILTER (WHERE setup = 'setup1') AS a, max(v) FILTER (WHERE setup = 'setup2') AS b FROM sh GROUP BY metric)
SELECT 'history' AS axis, metric, round(a, 6) AS value_old, round(b, 6) AS value_new, CASE WHEN abs(b - a) < greatest(1e-9,
1e-3 * greatest(abs(a), abs(b))) THEN 'NEUTRAL' WHEN b > a THEN 'BETTER' ELSE 'WORSE' END AS status FROM ho
UNION ALL SELECT 'production', predictor || ' ~ ' || response, NULL, round(abs(c), 6), 'SIGNIFICANT' FROM pr WHERE abs(c) > t""")
def _(v):
    axes = [
        geo.axis_compliance(geo.compliance_summary(geo.compliance(v.setups)), "setup1", "setup2"),
        geo.axis_correlations(geo.response_correlations(_linked(v), list(_P), ["oil", "cut"], ["seed"]))
    ]
    return rounded(geo.summary_comparison(axes).select("axis", "metric", "value_old", "value_new", "status"))


SE = """
SELECT seed, well, a.kh_penetrated AS o, b.kh_penetrated AS n FROM (SELECT * FROM descriptors WHERE experiment = 1) a JOIN (SELECT *
FROM descriptors WHERE experiment = 2) b USING (seed, well)"""


@query(
    "f13_status",
    f"SELECT seed, well, CASE WHEN abs(n - o) < greatest(1e-9, 1e-3 * greatest(abs(o), abs(n))) THEN 'NEUTRAL' WHEN n > o THEN 'BETTER' ELSE 'WORSE' END AS status FROM ({SE})"
)
def _(v):
    return _pair(v).select("seed", "well", status("o", "n", F.lit(">")).alias("status"))


def _pair(v):
    d = v.descriptors
    return d.where("experiment = 1").select("seed", "well", F.col("kh_penetrated").alias("o")).join(
        d.where("experiment = 2").select("seed", "well", F.col("kh_penetrated").alias("n")), ["seed", "well"]
    )


@query("f14_comparison_rows", f"SELECT seed, well, round(n - o, 2) AS delta, round(n / nullif(o, 0), 6) AS ratio FROM ({SE})")
def _(v):
    rows = _pair(v).select(
        F.col("seed").cast("string").alias("axis"), F.col("well").alias("metric"), F.lit("all").alias("scope"),
        F.col("o").alias("value_old"), F.col("n").alias("value_new"), F.lit(">").alias("direction")
    )
    return rounded(
        geo.comparison_rows(rows).select(F.col("axis").cast("long").alias("seed"), F.col("metric").alias("well"), "delta", "ratio"),
        {"delta": 2, "ratio": 6}
    )


@query("f17_tracker_decision", "SELECT user_id, bool_or(event_type = 'error') AND NOT bool_or(event_type = 'purchase') AS blocked FROM events GROUP BY ALL")
def _(v):
    kinds = v.table("events").groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    return kinds.select("user_id", (F.array_contains("k", "error") & ~F.array_contains("k", "purchase")).alias("blocked"))


H = "lo AS (SELECT comp, min(value) AS lo, max(value) AS hi FROM theta GROUP BY ALL)"


@query(
    "a49_histogram",
    H + """
 SELECT comp, least(floor(coalesce((value - lo) / nullif(hi - lo, 0), 0) * 15) + 1, 15)::INT AS bin, count(*) AS n FROM theta
JOIN lo USING (comp) GROUP BY ALL"""
)
def _(v):
    return geo.histogram(v.theta, ["comp"])


@query(
    "a49_density",
    """
f AS (SELECT comp, count(*) AS n, min(value) AS least, max(value) AS most, stddev_samp(value) * pow(count(*), -0.2) AS h FROM theta GROUP BY ALL HAVING count(*) >= 2 AND stddev_samp(value) > 0),
p AS (SELECT comp, (value - least) / ((most - least) / 1023) AS place FROM theta JOIN f USING (comp)),
w AS (SELECT comp, least(floor(place), 1022) AS bin, sum(1 - (place - least(floor(place), 1022))) AS w FROM p GROUP BY ALL
UNION ALL SELECT comp, least(floor(place), 1022) + 1, sum(place - least(floor(place), 1022)) FROM p GROUP BY ALL),
x AS (SELECT *, least - 3 * h + (most - least + 6 * h) * k / 19 AS x FROM f, range(0, 20) r(k))
SELECT comp, round(x, 5) AS x, round(sum(w * exp(-pow((x - least - (most - least) / 1023 * bin) / h, 2) / 2) / sqrt(2 * pi())) / max(n * h), 7) AS density
FROM x JOIN w USING (comp) GROUP BY comp, x"""
)
def _(v):
    return rounded(quantiles.density(v.theta, ["comp"], 20), {"x": 5, "density": 7})


@query(
    "a49_box_plot",
    """
SELECT comp, cluster_id, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median, round(quantile_cont(value, 0.75),
6) AS q3, round(min(value), 6) AS low, round(max(value), 6) AS high FROM theta GROUP BY ALL"""
)
def _(v):
    return rounded(geo.box_plot(v.theta, ["comp", "cluster_id"]))


@query(
    "a50_scaled_centroids",
    SHIFT + """
SELECT cluster_id, comp, round(prior_mean / greatest(abs(prior_mean), 1e-12), 6) AS prior_scaled,
round(post_mean / greatest(abs(prior_mean), 1e-12), 6) AS post_scaled,
round(CASE WHEN abs(prior_mean) > 1e-12 THEN (post_mean - prior_mean) / prior_mean * 100 ELSE 0 END, 6) AS shift_pct FROM shifted"""
)
def _(v):
    return rounded(geo.scaled_centroids(members.centroid_shift(v.theta, v.theta_post)))


MAN = """
mf AS (SELECT cluster_id, seed % 50 AS seed, model_id, ord FROM members), dy AS (SELECT cluster_id, seed % 50 AS seed, count(*) AS n
FROM members WHERE member_id % 3 > 0 GROUP BY ALL)"""


def _man(v):
    return v.members.select(
        "cluster_id", (F.col("seed") % 50).alias("seed"), "model_id", "ord"
    ), v.members.where("member_id % 3 > 0").groupBy("cluster_id", (F.col("seed") % 50).alias("seed")).agg(F.count("*").alias("n"))


@query(
    "j01_manifest_join",
    MAN + """
 SELECT d.cluster_id, d.seed, model_id, n FROM dy d JOIN (SELECT * FROM mf QUALIFY row_number() OVER (PARTITION BY cluster_id, seed
ORDER BY ord DESC) = 1) m ON m.cluster_id = d.cluster_id AND m.seed = d.seed"""
)
def _(v):
    m, d = _man(v)
    return d.join(geo.first_rows(m, ["cluster_id", "seed"], [F.desc("ord")]).drop("ord"), ["cluster_id", "seed"]).select("cluster_id", "seed", "model_id", "n")


@query(
    "j02_forecast_manifest",
    "SELECT f.metric, m.seed, m.cluster_id, round(sum(value), 2) AS total FROM forecast f JOIN members m USING (member_id) WHERE m.seed % 2 = 0 GROUP BY ALL"
)
def _(v):
    return rounded(
        v.forecast.select("member_id", "metric", "value").join(
            v.members.where("seed % 2 = 0"), "member_id"
        ).groupBy("metric", "seed", "cluster_id").agg(F.sum("value").alias("total")),
        2
    )


@query(
    "j03_training_set",
    """
SELECT t.member_id, comp, round(t.value, 6) AS z, metric, well, time, round(f.value, 4) AS d FROM theta t JOIN forecast f USING (member_id)"""
)
def _(v):
    return rounded(
        v.theta.select("member_id", "comp", F.col("value").alias("z")).join(
            v.forecast.select("member_id", "metric", "well", "time", F.col("value").alias("d")), "member_id"
        ),
        {"d": 4}
    )


@query(
    "j04_history_join",
    HISTORY + """
, sm AS (SELECT model_id, seed FROM members QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY ord) = 1), h4 AS (SELECT mm.setup,
mm.model_id, mm.cluster_x, sm.seed, l.cluster AS cluster_y, l.n_bodies_26 FROM mm LEFT JOIN sm ON sm.model_id = mm.model_id LEFT
JOIN latest l ON l.seed = sm.seed) SELECT * FROM h4"""
)
def _(v):
    return geo.join_history(
        geo.model_misfit(geo.compliance(v.setups)), v.connectivity, v.members.select("model_id", "seed", "ord")
    ).select("setup", "model_id", "cluster_x", "seed", "cluster_y", "n_bodies_26")


@query("j05_direct_join", HISTORY + "SELECT setup, model_id, cluster_x, cluster_y, n_bodies_26 FROM hist")
def _(v):
    return geo.join_history(geo.model_misfit(geo.compliance(v.setups)), v.connectivity).select("setup", "model_id", "cluster_x", "cluster_y", "n_bodies_26")


@query(
    "j06_responses_join",
    LINKED + """
, tp AS (SELECT member_id, value AS price FROM theta WHERE comp = 'price') SELECT seed, round(price, 6) AS price, round(oil, 2) AS oil,
round(cut, 8) AS cut, net AS net_sand_penetrated FROM tp JOIN lk ON lk.seed = tp.member_id"""
)
def _(v):
    t = v.theta.where("comp = 'price'").select(F.col("member_id").alias("seed"), F.col("value").alias("price"))
    return rounded(t.join(_linked(v), "seed").select("seed", "price", "oil", "cut", "net_sand_penetrated"), {"oil": 2, "cut": 8})


@query(
    "j07_descriptors_connectivity",
    PERMODEL + "SELECT pm.seed, net AS net_sand_penetrated, n_bodies_26, top1_n_cells FROM pm LEFT JOIN c1 ON c1.seed = pm.seed"
)
def _(v):
    return geo.descriptors_per_model(v.descriptors, v.connectivity).select("seed", "net_sand_penetrated", "n_bodies_26", "top1_n_cells")


@query(
    "j08_per_well_join",
    PERMODEL + """
SELECT d.seed, d.experiment, d.well, round(pm.ntg, 8) AS mean_ntg_along_well, round(d.mean_ntg_along_well, 8) AS mean_ntg_along_well_w FROM pm LEFT
JOIN descriptors d ON d.seed = pm.seed"""
)
def _(v):
    d = v.descriptors.select("seed", "experiment", "well", F.col("mean_ntg_along_well").alias("mean_ntg_along_well_w"))
    return rounded(geo.descriptors_per_model(v.descriptors, v.connectivity).select("seed", "mean_ntg_along_well").join(d, "seed", "left"), 8)


@query("j10_observation_lookup", """
ob AS (SELECT o_custkey AS k, o_orderdate::DATE AS t, o_totalprice AS p FROM orders),
want AS (SELECT DISTINCT c_custkey AS k, make_date(y::INT, m::INT, 1) AS t FROM customer, range(1996, 1999) a(y), range(1, 13, 4) b(m)),
ex AS (SELECT k, t, min(p) AS p FROM ob GROUP BY ALL), mo AS (SELECT k, year(t) AS y, month(t) AS m, min_by(p, (t, p)) AS p FROM ob
GROUP BY ALL)
SELECT want.k, want.t, round(coalesce(ex.p, mo.p, 0), 2) AS p FROM want LEFT JOIN ex ON ex.k = want.k AND ex.t = want.t LEFT
JOIN mo ON mo.k = want.k AND mo.y = year(want.t) AND mo.m = month(want.t)""")
def _(v):
    from tidewell.sources.tables import lookup_observations

    ob = v.table("orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("t"), F.col("o_totalprice").alias("p"))
    c = v.table("customer").select(F.col("c_custkey").alias("k")).distinct()
    want = c.withColumn("y", F.explode(F.sequence(F.lit(1996), F.lit(1998)))).withColumn(
        "m", F.explode(F.array(F.lit(1), F.lit(5), F.lit(9)))
    ).select("k", F.make_date("y", "m", F.lit(1)).alias("t"))
    return rounded(lookup_observations(want, ob, ["k"], "t", "p"), 2)


@query(
    "j16_aligned_variants",
    """
SELECT coalesce(a.cluster_id, b.cluster_id) AS cluster_id, coalesce(a.comp, b.comp) AS comp, round(a.m, 6) AS one, round(b.m, 6) AS two
FROM (SELECT cluster_id, comp, avg(value) AS m FROM theta WHERE cluster_id < 3 GROUP BY ALL) a FULL JOIN (SELECT cluster_id, comp,
avg(value) AS m FROM theta_post WHERE cluster_id > 1 GROUP BY ALL) b ON a.cluster_id = b.cluster_id AND a.comp = b.comp"""
)
def _(v):
    m = lambda t: t.groupBy("cluster_id", "comp").agg(F.avg("value").alias("m"))
    return rounded(members.align({"one": m(v.theta.where("cluster_id < 3")), "two": m(v.theta_post.where("cluster_id > 1"))}, ["cluster_id", "comp"], "m"))


@query(
    "j17_paired_models",
    """
SELECT a.model_id, round(a.dev_field_cum_pct, 6) AS one, round(b.dev_field_cum_pct, 6) AS two FROM (SELECT * FROM setups
WHERE setup = 'setup1') a JOIN (SELECT * FROM setups WHERE setup = 'setup2') b USING (model_id)"""
)
def _(v):
    s = lambda n, c: v.setups.where(F.col("setup") == n).select("model_id", F.col("dev_field_cum_pct").alias(c))
    return rounded(s("setup1", "one").join(s("setup2", "two"), "model_id"))


@query("j18_distance_clusters", DISTANCE + "SELECT cluster_id, count(*) AS n, round(median(distance), 6) AS median_distance FROM ranked GROUP BY ALL")
def _(v):
    two = F.col("comp").isin("price", "size")
    d = linear.mahalanobis(v.theta.where(two), v.theta_post.where(two))
    return rounded(
        d.join(v.members.select("member_id", "cluster_id"), "member_id").groupBy("cluster_id").agg(
            F.count("*").alias("n"), F.median("distance").alias("median_distance")
        )
    )


@query(
    "u01_union_by_name",
    """
SELECT 'descriptors' AS kind, seed, well, net_sand_penetrated, NULL::BIGINT AS n_bodies_26 FROM descriptors UNION ALL SELECT 'connectivity',
seed, NULL, NULL, n_bodies_26 FROM connectivity"""
)
def _(v):
    return v.descriptors.select(F.lit("descriptors").alias("kind"), "seed", "well", "net_sand_penetrated").unionByName(
        v.connectivity.select(F.lit("connectivity").alias("kind"), "seed", "n_bodies_26"), allowMissingColumns=True
    )


@query("u02_intersect", "SELECT model_id FROM members WHERE cluster_id < 3 INTERSECT SELECT model_id FROM members WHERE cluster_id >= 2")
def _(v):
    return v.members.where("cluster_id < 3").select("model_id").intersect(v.members.where("cluster_id >= 2").select("model_id"))


@query("u03_except", "SELECT model_id FROM members WHERE cluster_id < 3 EXCEPT SELECT model_id FROM members WHERE cluster_id >= 3")
def _(v):
    return v.members.where("cluster_id < 3").select("model_id").subtract(v.members.where("cluster_id >= 3").select("model_id"))


@query(
    "m13_regression_r2",
    """
SELECT cluster AS c, count(*) AS n, round(covar_samp(net_sand_penetrated,
kh_penetrated) ** 2 / nullif(var_samp(net_sand_penetrated) * var_samp(kh_penetrated), 0), 7) AS r2 FROM descriptors GROUP BY ALL"""
)
def _(v):
    return rounded(linear.regression_r2(v.descriptors.withColumnRenamed("cluster", "c"), ["c"], "net_sand_penetrated", "kh_penetrated"), 7)


@query("m14_cross_validated_r2", """
dd AS (SELECT experiment, seed * 10 + ascii(well) AS key, net_sand_penetrated AS x, kh_penetrated AS y FROM descriptors),
fo AS (SELECT *, (row_number() OVER (PARTITION BY experiment ORDER BY md5('42-' || key), key) - 1) % 5 AS fold,
count(*) OVER (PARTITION BY experiment) AS n FROM dd),
mo AS (SELECT experiment, o AS out, covar_samp(x, y) / var_samp(x) AS b, avg(x) AS mx, avg(y) AS my FROM fo, range(0, 5) r(o)
WHERE fold <> o AND n >= 10 GROUP BY ALL),
er AS (SELECT f.experiment, m.out, (y - my - b * (x - mx)) ** 2 AS e, (y - avg(y) OVER (PARTITION BY f.experiment, m.out)) ** 2 AS t
FROM fo f JOIN mo m ON m.experiment = f.experiment AND m.out = f.fold)
SELECT experiment, round(avg(s), 6) AS r2_cv FROM (SELECT experiment, out, 1 - sum(e) / sum(t) AS s FROM er GROUP BY ALL) GROUP BY ALL""")
def _(v):
    d = v.descriptors.withColumn("key", F.col("seed") * 10 + F.ascii("well"))
    return rounded(linear.cross_validated_r2(d, ["experiment"], "key", "net_sand_penetrated", "kh_penetrated"))


@query("m15_r2_uplift")
def _(v):
    return linear.r2_uplift(_linked(v).withColumn("g", F.lit("all")), "g", ["net_sand_penetrated"], ["kh_penetrated", "n_bodies_26"], "oil", draws=200)


@query("m16_src2")
def _(v):
    return linear.src2(_linked(v).withColumn("g", F.lit("all")), "g", ["net_sand_penetrated", "kh_penetrated", "n_bodies_26"], "oil", draws=200)


@query("m15_bootstrap_means", """
rw AS (SELECT experiment, cluster, net_sand_penetrated AS v, row_number() OVER (PARTITION BY experiment, cluster ORDER BY seed * 10 + ascii(well)) AS i,
count(*) OVER (PARTITION BY experiment, cluster) AS n FROM descriptors),
dr AS (SELECT experiment, cluster, b, (floor(('0x' || substr(md5('1-' || b || '-' || i), 1, 8))::BIGINT / 4294967296.0 * n) + 1)::BIGINT AS j FROM rw,
range(0, 50) r(b)),
ms AS (SELECT dr.experiment, dr.cluster, b, avg(v) AS m FROM dr JOIN rw ON rw.experiment = dr.experiment AND rw.cluster = dr.cluster AND rw.i = dr.j GROUP BY ALL)
SELECT experiment, cluster, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM ms GROUP BY ALL""")
def _(v):
    d = v.descriptors.withColumn("key", F.col("seed") * 10 + F.ascii("well"))
    return rounded(linear.bootstrap_means(d, ["experiment", "cluster"], "key", "net_sand_penetrated", 50, 1))


@query("m17_production_link")
def _(v):
    rows = _linked(v).join(v.members.select(F.col("member_id").alias("seed"), F.col("cluster_id").alias("cluster")), "seed")
    return production.production_link(rows, ["net_sand_penetrated"], ["kh_penetrated", "n_bodies_26"], ["oil", "cut"], draws=100)["uplift"]


@query(
    "k06_latex_rows",
    "SELECT setup, phase, replace(setup, '_', '\\_') || ' & ' || replace(phase, '_', '\\_') || ' & ' || n || ' & ' || printf('%.3f', a) || ' & ' || printf('%.3e', c) || ' & ' || CASE WHEN phase = 'by_qty' THEN '--' ELSE printf('%.3f', a / 3000) END || ' \\\\' AS line FROM (SELECT 'set_up' AS setup, 'by_' || metric AS phase, count(*) AS n, round(avg(time), 5) AS a, round(avg(value), 3) AS c FROM rates GROUP BY ALL) m"
)
def _(v):
    m = v.rates.groupBy(F.concat(F.lit("by_"), "metric").alias("phase")).agg(
        F.lit("set_up").alias("setup"), F.count("*").alias("m_members"), F.round(F.avg("time"), 5).alias("mean_width_ratio"),
        F.round(F.avg("value"), 3).alias("mean_crps")
    )
    return geo.latex_rows(m.withColumn("coverage", F.when(F.col("phase") != "by_qty", F.col("mean_width_ratio") / 3000)))


@query("s02_rounded_seed", "SELECT s_suppkey AS member_id, round_even(s_acctbal / 2, 0)::BIGINT AS seed_int FROM supplier")
def _(v):
    return v.table("supplier").select(F.col("s_suppkey").alias("member_id"), half_even(F.col("s_acctbal") / 2).cast("long").alias("seed_int"))


@query(
    "s03_sheet_names",
    "n AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE '51-' || (p_partkey % 3 + 1) || '_' || p_size || '-' || p_partkey END AS name FROM part) SELECT p_partkey, CASE WHEN regexp_matches(name, '^51-(\\d)_\\d+-(\\d+)$') THEN regexp_extract(name, '^51-(\\d)_\\d+-(\\d+)$', 1)::BIGINT END AS cluster, CASE WHEN regexp_matches(name, '^51-(\\d)_\\d+-(\\d+)$') THEN regexp_extract(name, '^51-(\\d)_\\d+-(\\d+)$', 2)::BIGINT END AS seed FROM n"
)
def _(v):
    p = v.table("part").withColumn(
        "name",
        F.when(F.col("p_partkey") % 5 == 0, "x").otherwise(
            F.concat(
                F.lit("51-"), (F.col("p_partkey") % 3 + 1).cast("string"), F.lit("_"), F.col("p_size").cast("string"), F.lit("-"),
                F.col("p_partkey").cast("string")
            )
        )
    )
    c, s = sheet_key("name", r"^51-(\d)_\d+-(\d+)$")
    return p.select("p_partkey", c.alias("cluster"), s.alias("seed"))


@query("s07_forecast_anomaly", "SELECT member_id, metric, well, time, round(value, 4) AS value FROM forecast")
def _(v):
    return rounded(series.forecast_anomaly(v.cumulative, 2000).select("member_id", "metric", "well", "time", "value"), 4)
