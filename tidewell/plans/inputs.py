"""Queries on readers and decks, with inputs made from the tables."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import geology as geo
from tidewell.operators import geometry
from tidewell.plans.ensemble import rounded
from tidewell.plans.geology import LAB6, LAB26, PERFS, WP, _layers, _mask, _perfs, _pillars, _tracks, _well_cells
from tidewell.plans.registry import query
from tidewell.sources import decks, matrices, sinks, tables

DYN = """
mf AS (SELECT cluster_id, seed % 400 AS seed, model_id, ord FROM members),
dy AS (SELECT CASE WHEN r.member_id % 6 = 0 THEN 'notes' ELSE '51-' || r.cluster_id || '_1-' || (seed % 400) END AS sheet, r.cluster_id,
seed % 400 AS seed, r.metric, r.well, r.time, r.value FROM rates r JOIN members m USING (member_id)
WHERE NOT (r.member_id % 11 = 0 AND time = 1995)),
lm AS (SELECT * FROM mf QUALIFY row_number() OVER (PARTITION BY cluster_id, seed ORDER BY ord DESC) = 1),
jn AS (SELECT d.*, model_id, ord FROM dy d JOIN lm USING (cluster_id, seed) WHERE sheet <> 'notes'),
sz AS (SELECT cluster_id, seed, count(*) AS n, min(ord) AS o FROM jn GROUP BY ALL)
"""


def _dynamics(v):
    m = v.members.select("member_id", (F.col("seed") % 400).alias("s"))
    r = v.rates.join(m, "member_id").where("not (member_id % 11 = 0 and time = 1995)")
    return r.select(
        F.when(F.col("member_id") % 6 == 0, "notes").otherwise(
            F.concat(F.lit("51-"), F.col("cluster_id").cast("string"), F.lit("_1-"), F.col("s").cast("string"))
        ).alias("sheet"),
        "metric", "well", "time", "value"
    )


@query(
    "s01_load_ensemble",
    DYN + """
SELECT cluster_id, seed, model_id, count(*) AS n, round(sum(value), 2) AS total FROM jn JOIN sz USING (cluster_id, seed)
WHERE n = (SELECT min_by(n, o) FROM sz) GROUP BY ALL"""
)
def _(v):
    manifest = v.members.select("cluster_id", (F.col("seed") % 400).alias("seed"), "model_id", "ord")
    return rounded(
        tables.load_ensemble(manifest, _dynamics(v)).groupBy("cluster_id", "seed", "model_id").agg(
            F.count("*").alias("n"), F.sum("value").alias("total")
        ),
        2
    )


@query(
    "s02_load_parameters",
    """
SELECT s_suppkey AS model_id, (s_suppkey % 3 + 1)::BIGINT AS cluster_id, round_even(s_acctbal / 2, 0)::BIGINT AS seed,
'SHEET_' || (s_suppkey % 3 + 1) AS sheet, s_acctbal AS bal FROM supplier WHERE s_suppkey % 10 > 0"""
)
def _(v):
    s = v.table("supplier").select(
        F.when(F.col("s_suppkey") % 10 > 0, F.col("s_suppkey")).alias("MODEL"), (F.col("s_acctbal") / 2).alias("SEED"),
        F.col("s_acctbal").alias("bal"), (F.col("s_suppkey") % 3 + 1).alias("c")
    )
    return tables.load_parameters({f"SHEET_{i}": s.where(F.col("c") == i) for i in (1, 2, 3)}, ["bal"]).drop("sheet_no")


@query(
    "s04_classify_wells",
    """
h AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'WELL' WHEN 1 THEN 'INJ' WHEN 2 THEN 'WELL.' ELSE 'X' END || p_size AS w FROM part)
SELECT w AS well, CASE WHEN w LIKE 'WELL%' THEN 'producer' ELSE 'injector' END AS kind FROM h WHERE w NOT LIKE '%.%' AND w NOT LIKE 'X%'"""
)
def _(v):
    k = F.col("p_size") % 4
    name = F.concat(F.when(k == 0, "WELL").when(k == 1, "INJ").when(k == 2, "WELL.").otherwise("X"), F.col("p_size").cast("string"))
    return tables.classify_wells(v.table("part").select(F.concat(F.lit("oil rate ("), name, F.lit(")")).alias("header")))


@query(
    "s05_melt_dynamics",
    """
SELECT c_custkey AS k, metric, well,
CASE WHEN metric = 'bal' AND well = 'A' AND c_custkey % 7 > 0 THEN c_acctbal WHEN metric = 'nat' AND well = 'B' THEN c_nationkey ELSE 0 END::DOUBLE AS value
FROM customer, (VALUES ('bal'), ('nat')) m(metric), (VALUES ('A'), ('B')) w(well)"""
)
def _(v):
    c = v.table("customer").select(
        F.col("c_custkey").alias("k"),
        F.when(F.col("c_custkey") % 7 > 0, F.col("c_acctbal").cast("string")).otherwise("n/a").alias("bal (A)"),
        F.col("c_nationkey").alias("nat (B)")
    )
    return tables.melt_dynamics(c, ["k"], ["bal", "nat"], ["A", "B"])


@query(
    "s06_last_in_year",
    """
w AS (SELECT c_custkey AS k, y::BIGINT AS year FROM customer, range(1995, 1999) r(y)), l AS (SELECT o_custkey AS k,
year(o_orderdate)::BIGINT AS year, max_by(o_totalprice, (o_orderdate, o_totalprice)) AS p FROM orders GROUP BY ALL) SELECT w.k, w.year,
coalesce(p, 0) AS p FROM w LEFT JOIN l USING (k, year)"""
)
def _(v):
    want = v.table("customer").select(F.col("c_custkey").alias("k"), F.explode(F.expr("sequence(1995L, 1998L)")).alias("year"))
    return tables.last_in_year(
        want, v.table("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), F.col("o_totalprice").alias("p")),
        ["k"], "t", "p"
    )


@query("s07_load_forecast", """
mf AS (SELECT cluster_id, seed, model_id, ord FROM members QUALIFY row_number() OVER (PARTITION BY cluster_id, seed ORDER BY ord) = 1),
fc AS (SELECT f.cluster_id, m.seed, f.metric, round(sum(f.value), 2) AS total, count(*) AS n FROM forecast f
JOIN members m USING (member_id) SEMI JOIN (SELECT ord FROM mf) x ON x.ord = m.ord GROUP BY ALL)
SELECT * FROM fc""")
def _(v):
    one = geo.first_rows(v.members, ["cluster_id", "seed"], ["ord"])
    dyn = v.cumulative.drop("cluster_id").join(one, "member_id").select(
        F.concat(F.col("cluster_id").cast("string"), F.lit("_9-"), F.col("seed").cast("string")).alias("sheet"), "metric", "well", "time",
        "value"
    )
    out = tables.load_forecast(one.select("cluster_id", "seed", "model_id", "ord"), dyn, 2000)
    return rounded(out.groupBy("cluster_id", "seed", "metric").agg(F.sum("value").alias("total"), F.count("*").alias("n")), 2)


def _cube_files(v):
    # a deck every 20 parts, with two cells a part
    t = v.table("part").groupBy(F.floor(F.col("p_partkey") / 20).alias("d")).agg(
        F.array_sort(F.collect_list(F.struct("p_partkey", F.col("p_size").cast("string").alias("s")))).alias("r")
    )
    body = F.array_join(F.transform("r", lambda x: F.concat(F.lit("2*"), x["s"])), " ")
    return t.select(
        F.concat(F.lit("deck"), F.col("d").cast("string")).alias("path"),
        F.concat(F.lit("-- cube\nNOECHO\nPORO\n"), body, F.lit(" -- values\n/\n")).alias("text")
    )


@query(
    "s08_read_cubes",
    """
r AS (SELECT 'deck' || (p_partkey // 20) AS path, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) - 1 AS n,
p_size::DOUBLE AS value FROM part) SELECT path, 2 * n + t AS flat, value FROM r, range(0, 2) x(t)"""
)
def _(v):
    return decks.cubes(_cube_files(v), "PORO", 40)


@query(
    "s09_read_grids",
    """
SELECT 'grid' || s_suppkey AS path, s_suppkey + 2 AS nx, 3::BIGINT AS ny, 4::BIGINT AS nz, 1::BIGINT AS n_faults, true AS has_coord,
false AS has_zcorn FROM supplier"""
)
def _(v):
    k = (F.col("s_suppkey") + 2).cast("string")
    text = F.concat(F.lit("SPECGRID\n "), k, F.lit(" 3 4 1 F /\nFAULTS\n'F1' 1 2 3 4 5 6 'I' /\n'short' 1 /\n/\nCOORD\n 3*1.5 2 /\nZCORN\n 1 bad /\n"))
    return decks.grids(v.table("supplier").select(F.concat(F.lit("grid"), F.col("s_suppkey").cast("string")).alias("path"), text.alias("text")))


@query(
    "s10_read_tracks",
    """
SELECT 'w' || s_suppkey AS path, 'P1' AS well, n AS seq, s_suppkey + n::DOUBLE AS x, 2.0::DOUBLE AS y, n * 3.0::DOUBLE AS z,
n * 5.0::DOUBLE AS md FROM supplier, range(0, 3) r(n)"""
)
def _(v):
    k = F.col("s_suppkey")
    lines = [F.concat((k + n).cast("string"), F.lit(f" 2 {n * 3} {n * 5}" + (" /" if n == 2 else "") + "\n")) for n in range(3)]
    return decks.tracks(
        v.table("supplier").select(
            F.concat(F.lit("w"), k.cast("string")).alias("path"),
            F.concat(F.lit("WELLTRACK 'P1'\nbad line\n"), *lines, F.lit("WELLTRACK 'EMPTY'\n/\n")).alias("text")
        )
    )


@query("s11_read_perforations", "SELECT 'w' || s_suppkey AS path, 'P1' AS well, s_suppkey::DOUBLE AS md_low, s_suppkey + 10.0::DOUBLE AS md_high FROM supplier")
def _(v):
    k = F.col("s_suppkey")
    text = F.concat(
        F.lit("COMPDATMD\n'P1' 1 "), k.cast("string"), F.lit(" "), (k + 10).cast("string"),
        F.lit(" MD OPEN /\n'P1' 1 0 1 MD SHUT /\n/\nCOMPDATMD\n'P2' 1 0 1 MD OPEN /\n/\n")
    )
    return decks.perforations(v.table("supplier").select(F.concat(F.lit("w"), k.cast("string")).alias("path"), text.alias("text")))


@query(
    "s12_scan_decks",
    """
SELECT '/x/' || s_suppkey AS directory,
CASE WHEN s_suppkey % 3 = 1 THEN '/x/' || s_suppkey || '/' || (s_suppkey % 5) || '_centroid.data' WHEN s_suppkey % 3 = 2 THEN '/x/' || s_suppkey || '/run.data' ELSE '/x/' || s_suppkey || '/2_1-' || s_suppkey || '.data' END AS path,
CASE WHEN s_suppkey % 3 = 0 THEN 2 WHEN s_suppkey % 3 = 1 THEN s_suppkey % 5 END::BIGINT AS cluster,
CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS seed, s_suppkey % 3 = 1 AS centroid FROM supplier"""
)
def _(v):
    k = F.col("s_suppkey")
    s = k.cast("string")
    name = F.when(
        k % 3 == 1, F.concat((k % 5).cast("string"), F.lit("_centroid.data"))
    ).when(k % 3 == 2, "run.data").otherwise(F.concat(F.lit("2_1-"), s, F.lit(".data")))
    base = v.table("supplier").select(F.concat(F.lit("/x/"), s, F.lit("/")).alias("d"), name.alias("n"))
    return decks.scan_decks(
        base.select(F.concat("d", "n").alias("path")).union(
            base.select(F.concat("d", F.lit("z.data")))
        ).union(base.select(F.concat("d", F.lit("0.txt"))))
    )


@query("s13_missing_is_empty", "SELECT 'there' AS source, r_regionkey::BIGINT AS a, r_name AS b FROM region")
def _(v):
    read = lambda path, fmt: tables.read_or_empty(v.spark, path, "a BIGINT, b STRING", fmt)
    folder = sinks.scratch(v.spark, "s13")
    there = sinks.write_table(v.table("region").select(F.col("r_regionkey").cast("long").alias("a"), F.col("r_name").alias("b")), f"{folder}/region", "csv")
    return read(there, "csv").select(F.lit("there").alias("source"), "a", "b").unionByName(
        read(f"{folder}/missing", "csv").select(F.lit("missing").alias("source"), "a", "b")
    )


@query("s14_cached", "SELECT n_nationkey, n_name FROM nation")
def _(v):
    path = f"{sinks.scratch(v.spark, 's14')}/nation"
    tables.cached(v.spark, path, lambda: v.table("nation").select("n_nationkey", "n_name"))
    # the second call reads what the first has written
    return tables.cached(v.spark, path, lambda: v.table("nation").select("n_nationkey", F.lit("built again").alias("n_name")))


@query("k01_write_tables", "SELECT metric, well, time, round(sum(value), 2) AS value FROM rates GROUP BY ALL")
def _(v):
    folder = sinks.scratch(v.spark, "k01")
    sinks.write_tables(
        {
            "rates": v.rates.groupBy("metric", "well", "time").agg(F.round(F.sum("value"), 2).alias("value")),
            "none": v.members.where("false")
        },
        folder, skip_empty=("none",)
    )
    return v.spark.read.parquet(f"{folder}/rates").unionByName(
        tables.read_or_empty(v.spark, f"{folder}/none", "metric string, well string, time bigint, value double", "parquet")
    )


@query(
    "k03_write_plan",
    """
SELECT member_id, CASE member_id % 3 WHEN 0 THEN 'resimulate' ELSE 'proxy' END AS role, 'plan' AS source FROM members UNION ALL
SELECT member_id, CASE member_id % 3 WHEN 0 THEN 'resimulate' ELSE 'proxy' END, 'validation' FROM members WHERE member_id % 2 = 0"""
)
def _(v):
    folder = sinks.scratch(v.spark, "k03")
    sinks.write_plan(
        v.members.select(
            "member_id", F.when(F.col("member_id") % 3 == 0, "resimulate").otherwise("proxy").alias("role"),
            (F.col("member_id") % 2 == 0).alias("validate")
        ),
        folder
    )
    read = lambda n: v.spark.read.schema("member_id long, role string, validate boolean").option("header", True).csv(f"{folder}/{n}")
    return read("resimulate").union(read("proxy_pool")).select("member_id", "role", F.lit("plan").alias("source")).union(
        read("validation").select("member_id", "role", F.lit("validation"))
    )


@query("k04_write_csv", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(v):
    path = sinks.write_table(v.table("supplier").select("s_suppkey", "s_name", "s_acctbal"), f"{sinks.scratch(v.spark, 'k04')}/supplier", "csv")
    return v.spark.read.schema("s_suppkey long, s_name string, s_acctbal double").option("header", True).csv(path)


@query(
    "k07_html_report",
    """SELECT '<!DOCTYPE html><meta charset=''utf-8''><h1>A &amp; B</h1><h2>regions</h2><table><tr><th>r_regionkey</th><th>r_name</th></tr>' || string_agg('<tr><td>' || r_regionkey || '</td><td>' || r_name || '</td></tr>',
'' ORDER BY r_regionkey) || '</table><h2>none</h2><p>no rows</p>' AS page FROM region"""
)
def _(v):
    r = v.table("region").orderBy("r_regionkey")
    return v.spark.createDataFrame([(sinks.html_report("A & B", {"regions": r, "none": r.where("false")}),)], "page string")


@query("s15_seed_map", "SELECT s_suppkey % 30 AS model_id, round_even(min_by(s_acctbal / 2, s_suppkey), 0)::BIGINT AS seed FROM supplier GROUP BY ALL")
def _(v):
    return tables.seed_map(
        v.table("supplier").select(
            (F.col("s_suppkey") % 30).alias("MODEL"), (F.col("s_acctbal") / 2).alias("SEED"), F.col("s_suppkey").alias("ord")
        ),
        "ord"
    )


@query("s16_theta_by_sheet", "SELECT (s_suppkey % 2 + 1)::BIGINT AS cluster_id, s_suppkey AS model_id, s_acctbal AS bal FROM supplier")
def _(v):
    s = v.table("supplier").select(F.col("s_suppkey").alias("MODEL"), F.col("s_acctbal").alias("bal"))
    return tables.theta_by_sheet([s.where("MODEL % 2 = 0"), s.where("MODEL % 2 = 1")], ["bal"])


@query("k05_config_hash", "SELECT s_suppkey AS id, substr(sha256('{\"bal\": ' || s_suppkey || ', \"seed\": 42}'), 1, 16) AS hash FROM supplier")
def _(v):
    def hashes(batches):
        for b in batches:
            b["hash"] = [sinks.config_hash({"seed": 42, "bal": int(k)}) for k in b["id"]]
            yield b

    return v.table("supplier").select(F.col("s_suppkey").cast("long").alias("id")).mapInPandas(hashes, "id long, hash string")


@query(
    "k05_sidecar",
    "SELECT 'theta' AS artefact, substr(sha256('{\"top\": ' || max(s_suppkey) || '}'), 1, 16) AS config_hash, 7::BIGINT AS seed, count(*)::BIGINT AS rows FROM supplier"
)
def _(v):
    path = f"{sinks.scratch(v.spark, 'k05')}/theta"
    top, n = v.table("supplier").agg(F.max("s_suppkey"), F.count("*")).first()
    sinks.write_sidecar(v.spark, path, "theta", {"top": top}, 7, rows=n)
    return v.spark.read.schema(
        "artefact string, config_hash string, seed long, extra struct<rows: long>"
    ).json(f"{path}.meta").select("artefact", "config_hash", "seed", "extra.rows")


def _renamed(sql: str, tag: str) -> str:
    return re.sub(r"\b(walk|lowest|lab|hits|wp)\b", rf"\1_{tag}", sql)


BODIES = ", ".join(
    f"""
fl_{c} AS (SELECT l.model, body, count(*) AS n, (max(i) - min(i) + 1)::BIGINT AS ei, (max(j) - min(j) + 1)::BIGINT AS ej, (max(k) - min(k) + 1)::BIGINT AS ek FROM lab_{c} l JOIN sd USING (model, flat) GROUP BY ALL),
rk_{c} AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY n DESC, body) AS r FROM fl_{c}),
sf_{c} AS (SELECT model, count(*) AS bodies, round(max(n) / sum(n), 8) AS largest, round(sum(n) FILTER (WHERE r <= 10) / sum(n), 8) AS ten, max(n) AS top, max(CASE WHEN r = 1 THEN round(greatest(ei, ej, ek) / least(ei, ej, ek), 8) END) AS shape FROM rk_{c} GROUP BY ALL)"""
    for c in ("six", "all")
)
CONNECTED = (
    _renamed(LAB6, "six") + ", " + _renamed(WP.replace(LAB6, LAB26), "all").replace("sd AS (SELECT model, flat, i, j, k FROM cells WHERE ntg = 1 AND permx > 100),", "") + ", " + BODIES + """,
ws AS (SELECT DISTINCT model, well FROM wc), bi AS (SELECT model, a, b FROM wp_all UNION ALL SELECT model, b, a FROM wp_all),
cn AS (SELECT ws.model, ws.well, count(bi.b) FILTER (WHERE bi.b LIKE 'INJ%') AS n FROM ws LEFT
JOIN bi ON bi.model = ws.model AND bi.a = ws.well WHERE ws.well NOT LIKE 'INJ%' GROUP BY ALL),
pr AS (SELECT model, count(*) AS producers, round(avg(n), 8) AS mean_n, max(n) AS max_n, count(*) FILTER (WHERE n > 0) AS linked FROM cn
GROUP BY ALL),
nj AS (SELECT model, count(*) FILTER (WHERE well LIKE 'INJ%') AS n FROM ws GROUP BY ALL),
md AS (SELECT model FROM sd UNION SELECT model FROM ws)
SELECT md.model, coalesce(a.bodies, 0) AS n_bodies_26, coalesce(a.largest, 0) AS frac_sand_in_largest_26, coalesce(a.ten,
0) AS frac_sand_in_top10_26, coalesce(s.bodies, 0) AS n_bodies_6, coalesce(s.largest, 0) AS frac_sand_in_largest_6, coalesce(a.top,
0) AS top1_n_cells, coalesce(a.shape, 0) AS top1_anisotropy,
coalesce(producers, 0) AS n_producers, coalesce(nj.n, 0) AS n_injectors, coalesce(mean_n, 0) AS mean_inj_connections_per_producer,
coalesce(max_n, 0) AS max_inj_connections_per_producer, coalesce(linked, 0) AS n_producers_connected_to_any_inj
FROM md LEFT JOIN sf_all a ON a.model = md.model LEFT JOIN sf_six s ON s.model = md.model LEFT JOIN pr ON pr.model = md.model LEFT
JOIN nj ON nj.model = md.model"""
)


@query("m23_deck_connectivity", CONNECTED)
def _(v):
    return rounded(geometry.deck_connectivity(_mask(v), _well_cells(v)).drop("top1_orientation_deg"), 8)


@query("a33_deck_descriptors", PERFS + """,
pv AS (SELECT model, well, i, j, k, dz_eff, model >= 3 OR greatest(least(md_in, md_out), 8) + 1e-6 < least(greatest(md_in, md_out),
21) AS perforated FROM tv)
SELECT model, well, count(*) AS n_cells_traversed, count(*) FILTER (WHERE perforated) AS n_cells_perforated,
count(*) FILTER (WHERE ntg = 1 AND permx > 100) AS n_sand_cells,
round(coalesce(sum(dz_eff) FILTER (WHERE ntg = 1 AND permx > 100 AND perforated), 0), 6) AS net_sand_penetrated,
round(coalesce(sum(permx * dz_eff) FILTER (WHERE ntg = 1 AND permx > 100 AND perforated), 0), 4) AS kh_penetrated,
round(avg((ntg = 1 AND permx > 100)::INT), 8) AS frac_channel_cells, round(coalesce(sum(ntg * dz_eff) / nullif(sum(dz_eff), 0), 0),
6) AS mean_ntg_along_well FROM pv JOIN cells USING (model, i, j, k) GROUP BY ALL""")
def _(v):
    t = geometry.traverse(_tracks(v), geometry.grid_quads(_pillars(v)).drop("cx", "cy"), _layers(v), _perfs(v), 0.5, 12.0)
    return rounded(geo.well_descriptors(t, v.cells, 100.0), {"kh_penetrated": 4, "frac_channel_cells": 8})


@query(
    "m20_layers_from_zcorn",
    """
z AS (SELECT p_partkey AS p, p_retailprice::DOUBLE AS z FROM part), q AS (SELECT (p % 8) // 2 AS i,
((p // 8) % 4) // 2 AS j, (p // 32) // 2 AS k, (p // 32) % 2 AS side, z FROM z) SELECT i::INT AS i, j::INT AS j, k::INT AS k,
round(avg(z) FILTER (WHERE side = 0), 6) AS z_top, round(avg(z) FILTER (WHERE side = 1), 6) AS z_bot FROM q GROUP BY ALL"""
)
def _(v):
    # a corner depth a part
    z = v.table("part").select(F.col("p_partkey").alias("pos"), F.col("p_retailprice").cast("double").alias("z"))
    return rounded(geometry.layers_from_zcorn(z, 4, 2))


@query("k02_qc_report", """
sp AS (SELECT comp, round(stddev_samp(value), 4) AS value FROM theta GROUP BY ALL), du AS (SELECT model_id, count(*) AS n FROM members
GROUP BY ALL HAVING count(*) > 1)
SELECT 'spread' AS source, comp AS name, value FROM sp UNION ALL SELECT 'duplicates', model_id::VARCHAR, n::DOUBLE FROM du UNION ALL
SELECT 'rank_check', 'full', count(*)::DOUBLE FROM members""")
def _(v):
    folder = sinks.scratch(v.spark, "k02")
    text = lambda df, a, b: df.select(F.col(a).cast("string").alias("name"), F.col(b).cast("double").alias("value"))
    spread = text(v.theta.groupBy("comp").agg(F.round(F.stddev_samp("value"), 4).alias("v")), "comp", "v")
    again = text(v.members.groupBy("model_id").count().where("count > 1"), "model_id", "count")
    sinks.write_qc({"spread": spread, "duplicates": again, "bounds": spread.where("false")}, {"full": v.members.count()}, folder)
    # bounds has no row, so it isn't written; duplicates are only if there are any
    read = lambda n: tables.read_or_empty(v.spark, f"{folder}/{n}", "name string, value double").select(F.lit(n).alias("source"), "name", "value")
    rank = v.spark.read.schema("full long").json(f"{folder}/rank_check").select(
        F.lit("rank_check").alias("source"), F.lit("full").alias("name"), F.col("full").cast("double").alias("value")
    )
    return read("spread").union(read("duplicates")).union(read("bounds")).union(rank)


@query(
    "t08_longest_run",
    """
r AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS NOT DISTINCT
FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id
ORDER BY event_id)), s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM r), n AS (SELECT user_id, run,
count(*) AS n FROM s GROUP BY ALL) SELECT user_id, max(n) AS longest FROM n GROUP BY ALL"""
)
def _(v):
    return geometry.runs(v.table("events"), ["user_id"], ["event_id"], "event_type").groupBy("user_id").agg(F.max("n").alias("longest"))


@query("k01_matrix_files", "SELECT dense_rank() OVER (ORDER BY member_id) - 1 AS row, comp_pos::BIGINT AS col, round(value, 9) AS value FROM theta")
def _(v):
    order = v.members.select("member_id", (F.row_number().over(Window.orderBy("member_id")) - 1).cast("long").alias("row"))
    cells = v.theta.join(order, "member_id").select("row", F.col("comp_pos").cast("long").alias("col"), "value")
    files = matrices.write_matrix(cells, f"{sinks.scratch(v.spark, 'k01')}/theta", 4, rows_a_file=256)
    return rounded(matrices.read_matrix(v.spark, [r.path for r in files.collect()]), 9)
