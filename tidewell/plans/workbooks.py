"""Queries on workbooks: files written from the tables, a sheet a member, and read back through the source."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.plans.ensemble import rounded
from tidewell.plans.registry import query
from tidewell.sources import sinks, workbooks

METRICS, WELLS = ["qty", "rev", "disc"], ["A", "N", "R"]
#: Sheets of one workbook of series.
A_BOOK = 150


def _files(v, df, order, **how) -> list[str]:
    folder = sinks.scratch(v.spark, "workbooks")
    written = workbooks.write_workbooks(df, folder, order, **how)
    return [r.path for r in v.spark.read.parquet(sinks.write_table(written, f"{folder}/files")).orderBy("workbook", "path").collect()]


def _series_files(v, rows, sheet, **how) -> list[str]:
    """Workbooks of A_BOOK sheets; a row a year with a column `metric (WELLx)` for each series."""
    named = rows.select("member_id", sheet.alias("sheet"), F.make_date(F.col("time").cast("int"), F.lit(12), F.lit(31)).alias("Date"), F.format_string("%s (WELL%s)", "metric", "well").alias("series"), "value")
    wide = named.groupBy("member_id", "sheet", "Date").pivot("series", [f"{m} (WELL{w})" for m in METRICS for w in WELLS]).agg(F.first("value"))
    books = F.format_string("%05d", F.floor(F.col("member_id") / A_BOOK))
    return _files(v, wide.withColumn("workbook", books).drop("member_id"), ["Date"], **how)


def _parameter_file(v, **how) -> str:
    """A workbook with a sheet a cluster, names in its fourth row; every tenth member has no MODEL."""
    bal = v.theta.where("comp = 'bal'").select(F.col("member_id").alias("m"), F.col("value").alias("bal"))
    p = v.members.join(bal, F.col("member_id") == F.col("m")).select(
        F.lit("parameters").alias("workbook"), F.format_string("Cluster_%d_fit", "cluster_id").alias("sheet"), F.when(F.col("member_id") % 10 > 0, F.col("member_id")).alias("MODEL"),
        (F.col("member_id") + 0.25).alias("SEED"), F.lit("text").alias("remark"), "bal", F.col("member_id").alias("order")
    )
    return _files(v, p, ["order"], title_rows=3, **how)[0]


GRID = """
mf AS (SELECT member_id, cluster_id FROM members WHERE member_id % 10 > 0),
series AS (SELECT s.member_id, s.cluster_id, s.time, s.metric, s.well, s.value FROM {table} s WHERE NOT (s.member_id % 11 = 0 AND s.time = 1995) AND s.member_id % 6 > 0),
grid AS (SELECT DISTINCT member_id, cluster_id, time FROM series),
filled AS (SELECT g.*, m.metric, w.well, coalesce(value, 0) AS value FROM grid g CROSS JOIN (VALUES ('qty'), ('rev'), ('disc')) m(metric)
CROSS JOIN (VALUES ('A'), ('N'), ('R')) w(well) LEFT JOIN series s ON s.member_id = g.member_id AND s.time = g.time AND s.metric = m.metric AND s.well = w.well),
jn AS (SELECT c.* FROM filled c JOIN mf USING (member_id))
"""


@query("s01_ensemble_workbooks", GRID.format(table="rates") + """,
sz AS (SELECT member_id, cluster_id, count(*) AS n FROM jn GROUP BY ALL)
SELECT jn.cluster_id, jn.member_id AS seed, jn.member_id AS model_id, count(*) AS n, round(sum(value), 2) AS total FROM jn JOIN sz USING (member_id)
WHERE n = (SELECT min_by(n, (cluster_id, member_id)) FROM sz) GROUP BY ALL""")
def _(v):
    rows = v.rates.where("not (member_id % 11 = 0 and time = 1995)")
    sheet = F.when(F.col("member_id") % 6 == 0, F.format_string("notes %d", "member_id")).otherwise(F.format_string("51-%d_1-%d", "cluster_id", "member_id"))
    out = workbooks.ensemble_workbooks(v.spark, _parameter_file(v, shared=True), _series_files(v, rows, sheet), ["bal"], METRICS, "Date")
    return rounded(out.groupBy("cluster_id", "seed", "model_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 2)


@query("s02_parameters_workbook", "SELECT member_id AS model_id, cluster_id, member_id AS seed, 'Cluster_' || cluster_id || '_fit' AS sheet, value AS bal FROM theta WHERE comp = 'bal' AND member_id % 10 > 0")
def _(v):
    return workbooks.parameters_workbook(v.spark, _parameter_file(v), ["bal"]).drop("sheet_no", "row")


@query("s07_forecast_workbooks", GRID.format(table="cumulative") + """,
base AS (SELECT member_id, metric, well, max_by(value, time) AS b FROM jn WHERE time < 2000 GROUP BY ALL),
late AS (SELECT jn.*, value - coalesce(b, 0) AS v FROM jn LEFT JOIN base USING (member_id, metric, well) WHERE time >= 2000),
sz AS (SELECT member_id, cluster_id, count(*) AS n FROM late GROUP BY ALL)
SELECT late.cluster_id, late.member_id AS seed, metric, count(*) AS n, round(sum(v), 2) AS total FROM late JOIN sz USING (member_id)
WHERE n = (SELECT min_by(n, (cluster_id, member_id)) FROM sz) GROUP BY ALL""")
def _(v):
    from tidewell.sources import tables

    rows = v.cumulative.where("not (member_id % 11 = 0 and time = 1995) and member_id % 6 > 0")
    files = _series_files(v, rows, F.format_string("%d_9-%d", "cluster_id", "member_id"), shared=True)
    dynamics = workbooks.dynamics_workbook(v.spark, files, METRICS, "Date")
    dynamics = v.spark.read.parquet(sinks.write_table(dynamics, f"{sinks.scratch(v.spark, 'forecast')}/series"))
    manifest = workbooks.parameters_workbook(v.spark, _parameter_file(v), ["bal"]).withColumn("ord", F.struct("sheet_no", "row"))
    out = tables.load_forecast(manifest, dynamics, F.lit("2000-01-01").cast("timestamp_ntz"))
    return rounded(out.groupBy("cluster_id", "seed", "metric").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 2)


@query("s15_seed_map_workbook", "SELECT member_id AS model_id, member_id AS seed FROM members WHERE member_id % 10 > 0")
def _(v):
    return workbooks.seed_map_workbook(v.spark, _parameter_file(v))


@query("s16_theta_workbook", """
places AS (SELECT cluster_id, row_number() OVER (ORDER BY 'Cluster_' || cluster_id || '_fit') AS place FROM (SELECT DISTINCT cluster_id FROM members))
SELECT place AS cluster_id, member_id AS model_id, value AS bal FROM theta JOIN places USING (cluster_id) WHERE comp = 'bal' AND member_id % 10 > 0""")
def _(v):
    return workbooks.theta_workbook(v.spark, _parameter_file(v), ["bal"])


@query("s17_workbook_cells", """
c AS (SELECT 'lines-' || (l_orderkey % 40) AS sheet, l_linenumber, l_quantity, l_shipdate, l_returnflag FROM lineitem)
SELECT sheet, (4 * count(*))::BIGINT AS n_cells, round(sum(l_linenumber + l_quantity), 2) AS numbers, count_if(l_returnflag = 'R')::BIGINT AS r_flags, min(l_shipdate)::DATE AS first_day FROM c GROUP BY ALL""")
def _(v):
    lines = v.table("lineitem").select(
        F.concat(F.lit("lines-"), F.col("l_orderkey") % 40).alias("sheet"), F.concat(F.lit("book "), F.col("l_orderkey") % 8).alias("workbook"), "l_linenumber", "l_quantity", F.col("l_shipdate").cast("date").alias("l_shipdate"), "l_returnflag"
    )
    cells = workbooks.read_workbook(v.spark, _files(v, lines, ["l_shipdate"], split=True))
    return rounded(cells.groupBy("sheet").agg(
        F.count("*").alias("n_cells"), F.sum("number").alias("numbers"), F.count_if(F.col("text") == "R").alias("r_flags"), F.min("time").cast("date").alias("first_day")
    ), 2)
