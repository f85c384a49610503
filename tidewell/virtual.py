"""A virtual ensemble over star-schema tables, so that every operator runs on real rows.

Members are suppliers, clusters their regions; parameters are averages of a
supplier's lines; metrics are yearly sums by return flag (the wells). BASE_SQL
states the same tables for an outside SQL engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spread of the virtual posterior by component: one collapses, one blows up.
SHRINK = {"disc": 0.05, "bal": 1.8}


class Virtual:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def members(self) -> DataFrame:
        n = self.table("nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("cluster_id"))
        s = self.table("supplier")
        k = F.col("s_suppkey")
        return s.join(n, s.s_nationkey == n.n_nationkey).select(
            k.alias("member_id"), (k % 60).alias("model_id"), "cluster_id", ((k * 13 + 5) % 1000).alias("seed"), k.alias("ord")
        )

    @cached_property
    def theta(self) -> DataFrame:
        """Prior parameters, long."""
        line, part = self.table("lineitem"), self.table("part")
        means = line.join(part, line.l_partkey == part.p_partkey).groupBy(F.col("l_suppkey").alias("member_id")).agg(
            F.avg("l_discount").alias("disc"), F.avg("p_retailprice").alias("price"), F.avg("p_size").alias("size")
        )
        wide = self.members.join(means, "member_id").join(
            self.table("supplier").select(F.col("s_suppkey").alias("member_id"), F.col("s_acctbal").alias("bal")), "member_id"
        )
        comps = ["bal", "disc", "price", "size"]
        long = wide.unpivot(["member_id", "cluster_id", "model_id"], comps, "comp", "value")
        return long.withColumn("comp_pos", F.array_position(F.array(*map(F.lit, comps)), F.col("comp")).cast("int") - 1)

    @cached_property
    def theta_post(self) -> DataFrame:
        mean = F.avg("value").over(Window.partitionBy("comp"))
        factor = F.lit(0.6)
        for comp, f in SHRINK.items():
            factor = F.when(F.col("comp") == comp, f).otherwise(factor)
        return self.theta.withColumn("value", 1.005 * mean + factor * (F.col("value") - mean))

    @cached_property
    def rates(self) -> DataFrame:
        """Yearly rates, long; kind is rate."""
        price, disc = F.col("l_extendedprice"), F.col("l_discount")
        wide = self.table("lineitem").groupBy(
            F.col("l_suppkey").alias("member_id"), F.col("l_returnflag").alias("well"), F.year("l_shipdate").cast("long").alias("time")
        ).agg(F.sum("l_quantity").alias("qty"), F.sum(price * (1 - disc)).alias("rev"), F.sum(price * disc).alias("disc"))
        long = wide.unpivot(["member_id", "well", "time"], ["qty", "rev", "disc"], "metric", "value")
        return long.join(self.members.select("member_id", "cluster_id"), "member_id").select(
            "member_id", "cluster_id", F.lit("rate").alias("kind"), "metric", "well", "time", "value"
        )

    @cached_property
    def cumulative(self) -> DataFrame:
        w = Window.partitionBy("member_id", "metric", "well").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
        return self.rates.withColumn("value", F.sum("value").over(w)).withColumn("kind", F.lit("cum"))

    @cached_property
    def sim(self) -> DataFrame:
        return self.rates.unionByName(self.cumulative)

    def post(self, sim: DataFrame) -> DataFrame:
        mean = F.avg("value").over(Window.partitionBy("kind", "metric", "well", "time"))
        return sim.withColumn("value", 1.02 * mean + 0.5 * (F.col("value") - mean))

    @cached_property
    def observed(self) -> DataFrame:
        """d_obs of the yearly rates: a little over the mean of the first tenth of the members; some zeros."""
        last = self.members.agg(F.max("member_id").alias("last"))
        few = self.members.crossJoin(F.broadcast(last)).where(F.col("member_id") * 10 <= F.col("last")).select("member_id")
        d = self.rates.join(few, "member_id", "left_semi").groupBy("kind", "metric", "well", "time").agg((F.avg("value") * 1.03).alias("d_obs"))
        return d.withColumn("d_obs", F.when((F.col("metric") == "disc") & (F.col("time") == 1995), 0.0).otherwise(F.col("d_obs")))

    @cached_property
    def forecast(self) -> DataFrame:
        """Cumulative values from 2000 on, less the last one before."""
        base = self.cumulative.where("time < 2000").groupBy("member_id", "metric", "well").agg(F.max_by("value", "time").alias("base"))
        late = self.cumulative.where("time >= 2000").join(base, ["member_id", "metric", "well"], "left")
        return late.withColumn("value", F.col("value") - F.coalesce("base", F.lit(0.0))).drop("base")

    @cached_property
    def setups(self) -> DataFrame:
        """Deviations of two setups from the observed totals, one row a member."""
        t = self.rates.where("metric = 'qty'").groupBy("member_id", "cluster_id").agg(
            F.sum("value").alias("total"), F.max("value").alias("top"), F.min("value").alias("low")
        )
        m = t.agg(F.avg("total").alias("m_total"), F.avg("top").alias("m_top"), F.avg("low").alias("m_low"))
        t = t.crossJoin(F.broadcast(m)).withColumn("f", F.explode(F.array(F.lit(1), F.lit(2))))
        dev = lambda a, b: F.abs(F.col(a) / F.col(b) - 1) * 100 / F.col("f")
        return t.select(
            F.concat(F.lit("setup"), F.col("f").cast("string")).alias("setup"), F.col("member_id").alias("model_id"), "cluster_id",
            dev("total", "m_total").alias("dev_field_cum_pct"), dev("top", "m_top").alias("dev_field_annual_max_pct"),
            dev("low", "m_low").alias("dev_well_top80_max_pct")
        )

    @cached_property
    def descriptors(self) -> DataFrame:
        """Rows like those of well descriptors: experiment, seed, cluster, well and four measures."""
        line = self.table("lineitem")
        g = line.groupBy(
            F.when(F.col("l_linestatus") == "F", 1).otherwise(2).cast("long").alias("experiment"), F.col("l_suppkey").alias("seed"),
            F.col("l_returnflag").alias("well")
        ).agg(
            F.sum("l_quantity").alias("net_sand_penetrated"), F.sum("l_extendedprice").alias("kh_penetrated"),
            F.avg("l_discount").alias("frac_channel_cells"), F.avg("l_tax").alias("mean_ntg_along_well")
        )
        return g.join(self.members.select(F.col("member_id").alias("seed"), F.col("cluster_id").alias("cluster")), "seed")

    @cached_property
    def connectivity(self) -> DataFrame:
        line = self.table("lineitem")
        g = line.groupBy(
            F.when(F.col("l_linestatus") == "F", 1).otherwise(2).cast("long").alias("experiment"), F.col("l_suppkey").alias("seed")
        ).agg(
            F.count_distinct("l_partkey").alias("n_bodies_26"),
            (F.max("l_extendedprice") / F.sum("l_extendedprice")).alias("frac_sand_in_largest_26"),
            F.max("l_quantity").alias("top1_n_cells"), F.avg("l_linenumber").alias("mean_inj_connections_per_producer")
        )
        return g.join(self.members.select(F.col("member_id").alias("seed"), F.col("cluster_id").alias("cluster")), "seed")

    @cached_property
    def cells(self) -> DataFrame:
        """Cubes of 4 x 5 x 3 cells, a cell a part and a model every 60 parts."""
        key = F.col("p_partkey")
        model, flat = F.floor(key / 60), key % 60
        h = (flat * 7919 + model * 104729 + 17 * (flat % 7) * (flat % 11) + 31 * F.col("p_size")) % 1000
        c = self.table("part").select(
            model.alias("model"), flat.alias("flat"), (flat % 4).cast("int").alias("i"), (F.floor(flat / 4) % 5).cast("int").alias("j"),
            F.floor(flat / 20).cast("int").alias("k"), h.alias("h")
        )
        return c.select(
            "model", "flat", "i", "j", "k", (F.col("h") / 4000.0).alias("poro"), (F.col("h") * F.col("h") / 1000.0).alias("permx"),
            F.when(F.col("h") % 3 > 0, 1.0).otherwise(0.0).alias("ntg")
        )


BASE_SQL = """
WITH RECURSIVE members AS (SELECT s_suppkey AS member_id, s_suppkey % 60 AS model_id, n_regionkey::BIGINT AS cluster_id,
(s_suppkey * 13 + 5) % 1000 AS seed, s_suppkey AS ord FROM supplier JOIN nation ON s_nationkey = n_nationkey),
theta_means AS (SELECT l_suppkey AS member_id, avg(l_discount) AS disc, avg(p_retailprice) AS price, avg(p_size) AS size FROM lineitem
JOIN part ON l_partkey = p_partkey GROUP BY 1),
theta AS (
  SELECT m.member_id, m.cluster_id, m.model_id, 'bal' AS comp, s_acctbal AS value, 0 AS comp_pos FROM members m
JOIN theta_means t USING (member_id) JOIN supplier ON s_suppkey = m.member_id
  UNION ALL SELECT m.member_id, m.cluster_id, m.model_id, 'disc', disc, 1 FROM members m JOIN theta_means t USING (member_id)
  UNION ALL SELECT m.member_id, m.cluster_id, m.model_id, 'price', price, 2 FROM members m JOIN theta_means t USING (member_id)
  UNION ALL SELECT m.member_id, m.cluster_id, m.model_id, 'size', size, 3 FROM members m JOIN theta_means t USING (member_id)),
theta_post AS (SELECT member_id, cluster_id, model_id, comp, comp_pos,
1.005::DOUBLE * m + (CASE comp WHEN 'disc' THEN 0.05 WHEN 'bal' THEN 1.8 ELSE 0.6 END)::DOUBLE * (value - m) AS value FROM (SELECT *,
avg(value) OVER (PARTITION BY comp) AS m FROM theta)),
wide AS (SELECT l_suppkey AS member_id, l_returnflag AS well, year(l_shipdate)::BIGINT AS time, sum(l_quantity) AS qty,
sum(l_extendedprice * (1 - l_discount)) AS rev, sum(l_extendedprice * l_discount) AS disc FROM lineitem GROUP BY ALL),
rates AS (SELECT w.member_id, m.cluster_id, 'rate' AS kind, metric, well, time, value FROM (UNPIVOT wide ON qty, rev,
disc INTO NAME metric VALUE value) w JOIN members m ON m.member_id = w.member_id),
cumulative AS (SELECT member_id, cluster_id, 'cum' AS kind, metric, well, time, sum(value) OVER (PARTITION BY member_id, metric, well
ORDER BY time ROWS UNBOUNDED PRECEDING) AS value FROM rates),
sim AS (SELECT * FROM rates UNION ALL SELECT * FROM cumulative),
post AS (SELECT member_id, cluster_id, kind, metric, well, time, 1.02::DOUBLE * m + 0.5::DOUBLE * (value - m) AS value FROM (SELECT *,
avg(value) OVER (PARTITION BY kind, metric, well, time) AS m FROM sim)),
observed AS (SELECT kind, metric, well, time,
CASE WHEN metric = 'disc' AND time = 1995 THEN 0.0::DOUBLE ELSE avg(value) * 1.03::DOUBLE END AS d_obs FROM rates
WHERE member_id * 10 <= (SELECT max(member_id) FROM members) GROUP BY kind, metric, well, time),
forecast AS (SELECT c.member_id, c.cluster_id, c.kind, c.metric, c.well, c.time, c.value - coalesce(b.base, 0) AS value FROM cumulative c
LEFT JOIN (SELECT member_id, metric, well, max_by(value, time) AS base FROM cumulative WHERE time < 2000
GROUP BY ALL) b ON b.member_id = c.member_id AND b.metric = c.metric AND b.well = c.well WHERE c.time >= 2000),
setup_totals AS (SELECT member_id, cluster_id, sum(value) AS total, max(value) AS top, min(value) AS low FROM rates WHERE metric = 'qty'
GROUP BY ALL),
setups AS (SELECT 'setup' || f AS setup, member_id AS model_id, cluster_id, abs(total / (SELECT avg(total)
FROM setup_totals) - 1) * 100 / f AS dev_field_cum_pct, abs(top / (SELECT avg(top)
FROM setup_totals) - 1) * 100 / f AS dev_field_annual_max_pct, abs(low / (SELECT avg(low)
FROM setup_totals) - 1) * 100 / f AS dev_well_top80_max_pct FROM setup_totals, (VALUES (1), (2)) v(f)),
descriptors AS (SELECT d.*, m.cluster_id AS cluster FROM (SELECT (CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END)::BIGINT AS experiment,
l_suppkey AS seed, l_returnflag AS well, sum(l_quantity) AS net_sand_penetrated, sum(l_extendedprice) AS kh_penetrated,
avg(l_discount) AS frac_channel_cells, avg(l_tax) AS mean_ntg_along_well FROM lineitem GROUP BY ALL) d
JOIN members m ON m.member_id = d.seed),
connectivity AS (SELECT d.*, m.cluster_id AS cluster FROM (SELECT (CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END)::BIGINT AS experiment,
l_suppkey AS seed, count(DISTINCT l_partkey) AS n_bodies_26, max(l_extendedprice) / sum(l_extendedprice) AS frac_sand_in_largest_26,
max(l_quantity) AS top1_n_cells, avg(l_linenumber) AS mean_inj_connections_per_producer FROM lineitem GROUP BY ALL) d
JOIN members m ON m.member_id = d.seed),
cell_ids AS (SELECT (p_partkey // 60)::BIGINT AS model, (p_partkey % 60)::BIGINT AS flat, p_size FROM part),
cells AS (SELECT model, flat, (flat % 4)::INT AS i, ((flat // 4) % 5)::INT AS j, (flat // 20)::INT AS k, h / 4000.0::DOUBLE AS poro,
h * h / 1000.0::DOUBLE AS permx, CASE WHEN h % 3 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ntg FROM (SELECT *,
(flat * 7919 + model * 104729 + 17 * (flat % 7) * (flat % 11) + 31 * p_size) % 1000 AS h FROM cell_ids))
"""
