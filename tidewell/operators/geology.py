"""Spread, compliance, realism, descriptors and comparison tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.columns import pearson, ratio, status, width_text

DESCRIPTORS = ["net_sand_penetrated", "kh_penetrated", "frac_channel_cells", "mean_ntg_along_well"]
CONNECTIVITY = ["n_bodies_26", "frac_sand_in_largest_26", "top1_n_cells", "mean_inj_connections_per_producer"]


def _block(v: str = "value") -> list[Column]:
    q = lambda p: F.percentile(v, F.lit(p))
    std = F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v))
    return [
        F.count("*").alias("n"), F.avg(v).alias("mean"), std.alias("std"), q(0.1).alias("p10"), q(0.5).alias("p50"), q(0.9).alias("p90"),
        (q(0.75) - q(0.25)).alias("iqr"), (F.max(v) - F.min(v)).alias("range")
    ]


def spread_block(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """n (missing values too), mean, std (one value: 0), quantiles, interquartile and full range."""
    return rows.groupBy(*by).agg(*_block(value))


def _melt(df: DataFrame, ids: list[str], cols: list[str]) -> DataFrame:
    here = [c for c in cols if c in df.columns]
    return df.select(*ids, *(F.col(c).cast("double").alias(c) for c in here)).unpivot(ids, here, "metric", "value")


def descriptor_spread(df: DataFrame, by_cluster: bool = True, cols: list[str] = DESCRIPTORS) -> DataFrame:
    """Two scopes: all rows, and means of each seed; a missing cluster is -1."""
    df = df.withColumn("cluster", F.coalesce("cluster", F.lit(-1).cast("long")))
    ids = ["experiment", "cluster"] if by_cluster else ["experiment"]
    every = spread_block(_melt(df, ids, cols), [*ids, "metric"]).withColumn("scope", F.lit("all_wells"))
    here = [c for c in cols if c in df.columns]
    seeds = df.groupBy(*ids, "seed").agg(*(F.avg(c).alias(c) for c in here))
    return every.unionByName(spread_block(_melt(seeds, ids, cols), [*ids, "metric"]).withColumn("scope", F.lit("model_mean")))


def connectivity_spread(df: DataFrame, cols: list[str] = CONNECTIVITY) -> DataFrame:
    df = df.withColumn("cluster", F.coalesce("cluster", F.lit(-1).cast("long")))
    return spread_block(_melt(df, ["experiment", "cluster"], cols), ["experiment", "cluster", "metric"])


def geological_width_ratio(spread: DataFrame, a: int = 1, b: int = 2, column: str = "std", scope: str | None = None) -> DataFrame:
    """Spread of experiment b over that of a, each averaged over clusters (and over scopes unless one is named)."""
    rows = spread if scope is None or "scope" not in spread.columns else spread.where(F.col("scope") == scope)
    p = rows.groupBy("metric").pivot("experiment", [a, b]).agg(F.avg(column))
    p = p.select("metric", F.col(str(a)).alias("spread_a"), F.col(str(b)).alias("spread_b")).where("spread_a is not null and spread_b is not null")
    r = ratio("spread_b", "spread_a")
    return p.select("metric", "spread_a", "spread_b", r.alias("width_ratio"), width_text(r).alias("interpretation"))


def compliance(setups: DataFrame, limits=(5.0, 10.0, 20.0)) -> DataFrame:
    """Add the pass flags of the three deviations and of all together."""
    devs, names = ["dev_field_cum_pct", "dev_field_annual_max_pct", "dev_well_top80_max_pct"], [
        "pass_field_cum_5pct", "pass_field_annual_10pct", "pass_well_top80_20pct"
    ]
    out = setups.withColumns({n: F.col(d) <= x for n, d, x in zip(names, devs, limits, strict=True)})
    return out.withColumn("pass_all_three", reduce(lambda x, y: x & y, map(F.col, names)))


def compliance_summary(df: DataFrame) -> DataFrame:
    """For each setup and cluster, and each setup (cluster -1): rows, passes and shares."""
    flags = ["pass_field_cum_5pct", "pass_field_annual_10pct", "pass_well_top80_20pct", "pass_all_three"]
    aggs = [*(F.count_if(f).alias(f"n_{f}") for f in flags), *(F.avg(F.when(F.col(f), 1.0).otherwise(0.0)).alias(f"share_{f}") for f in flags)]
    sets = df.groupingSets([[F.col("setup"), F.col("cluster_id")], [F.col("setup")]], F.col("setup"), F.col("cluster_id"))
    return sets.agg(F.count("*").alias("n"), *aggs).withColumnRenamed("cluster_id", "cluster").withColumn(
        "cluster", F.coalesce("cluster", F.lit(-1).cast("long"))
    ).select(
        "setup", "cluster", "n", *(f"n_{f}" for f in flags), *(f"share_{f}" for f in flags)
    )


def model_misfit(df: DataFrame) -> DataFrame:
    """Total of the three deviations; missing columns are an error."""
    need = ["setup", "model_id", "cluster_id", "dev_field_cum_pct", "dev_field_annual_max_pct", "dev_well_top80_max_pct", "pass_all_three"]
    if missing := [c for c in need if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    return df.select("setup", "model_id", "cluster_id", (F.col(need[3]) + F.col(need[4]) + F.col(need[5])).alias("total_misfit"), "pass_all_three")


def first_rows(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row for each key: the first in the order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def join_history(misfit: DataFrame, connectivity: DataFrame, seed_map: DataFrame | None = None) -> DataFrame:
    """Misfit with its model's seed and that seed's latest connectivity; without a map the model id is the seed. Both clusters stay, as cluster_x and cluster_y."""
    latest = first_rows(connectivity, ["seed"], [F.desc("experiment")]).withColumnRenamed("cluster", "cluster_y")
    m = misfit.withColumnRenamed("cluster_id", "cluster_x")
    if seed_map is None:
        m = m.withColumn("seed", F.col("model_id"))
    else:
        m = m.join(first_rows(seed_map, ["model_id"], ["ord"]).select("model_id", "seed"), "model_id", "left")
    return m.join(latest, "seed", "left")


def cross_axis(rows: DataFrame, x: str, y: str, by: list[str], least: int = 3) -> DataFrame:
    """Correlation of the complete rows of each group with at least `least` of them."""
    full = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return full.groupBy(*by).agg(F.count("*").alias("n"), pearson(x, y).alias("r")).where(F.col("n") >= least)


def conformance(theta: DataFrame, boxes: DataFrame) -> DataFrame:
    """Share of members in the closed box of their cluster and component, with median and range; a row all_three for members within all boxes."""
    rows = theta.join(boxes, ["cluster_id", "comp"])
    inside = F.col("value").between(F.col("lo"), F.col("hi"))
    one = rows.groupBy("cluster_id", "comp", "lo", "hi").agg(
        F.avg(F.when(inside, 1.0).otherwise(0.0)).alias("share"), F.median("value").alias("median"), F.min("value").alias("min"),
        F.max("value").alias("max")
    )
    every = rows.groupBy("cluster_id", "member_id").agg(F.bool_and(inside).alias("ok")).groupBy("cluster_id").agg(
        F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)).alias("share")
    )
    none = F.lit(None).cast("double")
    return one.unionByName(
        every.select(
            "cluster_id", F.lit("all_three").alias("comp"), none.alias("lo"), none.alias("hi"), "share", none.alias("median"),
            none.alias("min"), none.alias("max")
        )
    )


def facies_proportions(df: DataFrame) -> DataFrame:
    rows = df.where("experiment is not null and seed is not null and cluster is not null")
    return rows.groupBy("experiment", "seed", "cluster").agg(
        F.avg("frac_channel_cells").alias("mean_frac_channel"), F.avg("mean_ntg_along_well").alias("mean_ntg"),
        F.count("*").alias("n_wells"), (1 - F.avg("frac_channel_cells")).alias("mean_frac_background")
    )


def realism(df: DataFrame, cols: list[str]) -> DataFrame:
    """Median and interquartile range of the columns there are, by experiment and cluster."""
    here = [c for c in cols if c in df.columns]
    return df.groupBy("experiment", "cluster").agg(
        *(
            x for c in here for x in (
                F.median(c).alias(f"{c}_median"), (F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))).alias(f"{c}_iqr")
            )
        )
    )


def sand(cutoff: float | Column) -> Column:
    return (F.col("ntg") == 1) & (F.col("permx") > cutoff)


def well_descriptors(traversals: DataFrame, cells: DataFrame, cutoff: float | Column) -> DataFrame:
    """Descriptors of each well from its traversed cells (model, well, i, j, k, dz_eff, perforated); the cutoff is a number or a column of cells."""
    rows = traversals.join(cells.hint("merge"), ["model", "i", "j", "k"])
    s, dz = sand(cutoff), F.col("dz_eff")
    hit = s & F.col("perforated")
    return rows.groupBy("model", "well").agg(
        F.count("*").alias("n_cells_traversed"), F.count_if("perforated").alias("n_cells_perforated"), F.count_if(s).alias("n_sand_cells"),
        F.sum(F.when(hit, dz).otherwise(0.0)).alias("net_sand_penetrated"), F.sum(F.when(hit, F.col("permx") * dz).otherwise(0.0)).alias("kh_penetrated"),
        F.avg(F.when(s, 1.0).otherwise(0.0)).alias("frac_channel_cells"), F.coalesce(F.try_divide(F.sum(F.col("ntg") * dz), F.sum(dz)), F.lit(0.0)).alias("mean_ntg_along_well"),
    )


def descriptors_per_model(df: DataFrame, connectivity: DataFrame) -> DataFrame:
    """Sums and means of each seed, with the first connectivity row of that seed."""
    g = df.groupBy("seed").agg(
        F.sum("net_sand_penetrated").alias("net_sand_penetrated"), F.sum("kh_penetrated").alias("kh_penetrated"),
        F.avg("frac_channel_cells").alias("frac_channel_cells"), F.avg("mean_ntg_along_well").alias("mean_ntg_along_well")
    )
    return g.join(first_rows(connectivity, ["seed"], ["experiment"]).drop("experiment", "cluster"), "seed", "left")


def year_end_responses(sim: DataFrame, year: int, oil: str, water: str) -> DataFrame:
    """Cumulative oil and water cut of each member and well at a year; no cut where nothing flows."""
    v = lambda m: F.sum(F.when(F.col("metric") == m, F.col("value")))
    g = sim.where((F.col("kind") == "cum") & (F.col("time") == year)).groupBy("member_id", "well").agg(v(oil).alias("cum_oil"), v(water).alias("w"))
    total = F.col("cum_oil") + F.col("w")
    return g.select("member_id", "well", "cum_oil", F.when(total > 0, F.try_divide(F.col("w"), total)).alias("watercut"))


def response_correlations(rows: DataFrame, xs: list[str], ys: list[str], ids: list[str]) -> DataFrame:
    """Pairwise-complete correlation of every predictor with every response; under 3 pairs null. The threshold is 3 over the root of all rows."""
    a = rows.select(*ids, *(F.col(c).cast("double").alias(c) for c in xs)).unpivot(ids, xs, "predictor", "x")
    b = rows.select(*ids, *(F.col(c).cast("double").alias(c) for c in ys)).unpivot(ids, ys, "response", "y")
    g = a.join(b, ids).groupBy("predictor", "response").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("n"), pearson("x", "y").alias("c")
    )
    r = F.when(F.col("n") >= 3, F.col("c"))
    t = F.lit(3.0) / F.sqrt("n_rows")
    return g.select("predictor", "response", "n", r.alias("r"), t.alias("threshold"), F.coalesce(F.abs(r) > t, F.lit(False)).alias("significant"))


def per_well_correlations(rows: DataFrame, x: str, y: str) -> DataFrame:
    """As response_correlations for each well, with a threshold from the pairs."""
    full = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = full.groupBy("well").agg(F.count("*").alias("n"), pearson(x, y).alias("r")).where("n >= 3")
    t = F.lit(3.0) / F.sqrt("n")
    return g.select("well", "n", "r", t.alias("threshold"), F.coalesce(F.abs("r") > t, F.lit(False)).alias("significant"))


def cube_difference(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each pair of models: means and population variances of the cubes, differences of both, and the share of changed net flags.

    A cube that one model of a pair lacks (nulls) leaves its fields null.
    """
    rows = pairs.join(
        a.withColumnsRenamed({"model": "model_a", "poro": "poro_a", "permx": "permx_a", "ntg": "ntg_a"}).drop("i", "j", "k"), "model_a"
    ).join(
        b.withColumnsRenamed({"model": "model_b", "poro": "poro_b", "permx": "permx_b", "ntg": "ntg_b"}).drop("i", "j", "k"),
        ["model_b", "flat"]
    )
    aggs = [
        x for c in ("poro", "permx", "ntg") for x in (
            F.avg(f"{c}_a").alias(f"mean_{c}_a"), F.avg(f"{c}_b").alias(f"mean_{c}_b"), F.var_pop(f"{c}_a").alias(f"var_{c}_a"),
            F.var_pop(f"{c}_b").alias(f"var_{c}_b"), (F.avg(f"{c}_b") - F.avg(f"{c}_a")).alias(f"delta_{c}"),
            (F.var_pop(f"{c}_b") - F.var_pop(f"{c}_a")).alias(f"delta_var_{c}")
        )
    ]
    one = lambda c: F.avg(F.when(c, 1.0).when(~c, 0.0))
    return rows.groupBy("seed").agg(
        *aggs, one(F.col("ntg_a") == 1).alias("frac_net_a"), one(F.col("ntg_b") == 1).alias("frac_net_b"),
        one(F.col("ntg_a") != F.col("ntg_b")).alias("frac_netflag_changed")
    ).withColumn("delta_frac_net", F.col("frac_net_b") - F.col("frac_net_a"))


def matched_seeds(a: DataFrame, b: DataFrame) -> DataFrame:
    """Seeds of both experiments with the last deck of each, centroids left out."""
    pick = lambda d, n: first_rows(
        d.where("seed is not null and not centroid"), ["seed"], [F.desc("directory")]
    ).select("seed", F.col("directory").alias(f"directory_{n}"))
    return pick(a, "a").join(pick(b, "b"), "seed")


def model_index(decks: DataFrame, files: DataFrame, wells: DataFrame) -> DataFrame:
    """One row a deck: a 0/1 flag for each kind of file it has, and its number of wells."""
    kinds = ["grid", "poro", "permx", "ntg", "schedule", "satnum", "tracks", "results"]
    f = files.groupBy("directory").pivot("kind", kinds).agg(F.lit(1)).select("directory", *(F.coalesce(F.col(k), F.lit(0)).alias(f"has_{k}") for k in kinds))
    w = wells.groupBy("directory").agg(F.count_distinct("well").alias("n_wells"))
    return decks.join(f, "directory", "left").join(w, "directory", "left").fillna(0, [*(f"has_{k}" for k in kinds), "n_wells"])


def comparison_rows(values: DataFrame) -> DataFrame:
    """(axis, metric, scope, value_old, value_new, direction) with status, delta and ratio."""
    old, new = F.col("value_old"), F.col("value_new")
    return values.select(
        "axis", "metric", "scope", "value_old", "value_new", "direction", status(old, new, "direction").alias("status"),
        (new - old).alias("delta"), ratio(new, old).alias("ratio")
    )


def axis_means(df: DataFrame, axis: str, metrics: dict[str, tuple[Column, str]], scope: str = "all", old: int = 1, new: int = 2) -> DataFrame:
    """Rows of one axis: an aggregate of each metric for the old and new experiment."""
    parts = []
    for name, (agg, direction) in metrics.items():
        g = df.where(F.col("experiment").isin(old, new)).groupBy("experiment").agg(agg.cast("double").alias("v"))
        parts.append(
            g.agg(
                F.max(F.when(F.col("experiment") == old, F.col("v"))).alias("value_old"),
                F.max(F.when(F.col("experiment") == new, F.col("v"))).alias("value_new")
            ).select(
                F.lit(axis).alias("axis"), F.lit(name).alias("metric"), F.lit(scope).alias("scope"), "value_old", "value_new",
                F.lit(direction).alias("direction")
            )
        )
    return comparison_rows(reduce(DataFrame.unionByName, parts))


def axis_by_cluster(df: DataFrame, axis: str, metric: str, column: str, direction: str, old: int = 1, new: int = 2) -> DataFrame:
    """Rows of one axis for each cluster: means of a column for the old and new experiment."""
    g = df.groupBy("cluster").agg(
        F.avg(F.when(F.col("experiment") == old, F.col(column))).alias("value_old"),
        F.avg(F.when(F.col("experiment") == new, F.col(column))).alias("value_new")
    )
    return comparison_rows(
        g.select(
            F.lit(axis).alias("axis"), F.lit(metric).alias("metric"),
            F.concat(F.lit("cluster_"), F.col("cluster").cast("string")).alias("scope"), "value_old", "value_new",
            F.lit(direction).alias("direction")
        )
    )


def axis_compliance(summary: DataFrame, old: str, new: str) -> DataFrame:
    """Shares of passing members of two setups, all clusters together."""
    flags = [c for c in summary.columns if c.startswith("share_")]
    long = summary.where("cluster = -1").unpivot(["setup"], flags, "metric", "v")
    pick = lambda s: F.max(F.when(F.col("setup") == s, F.col("v")))
    return comparison_rows(
        long.groupBy("metric").agg(pick(old).alias("value_old"), pick(new).alias("value_new")).select(
            F.lit("history").alias("axis"), "metric", F.lit("all").alias("scope"), "value_old", "value_new", F.lit(">").alias("direction")
        )
    )


def _axis(axis: str, rows: DataFrame, direction: str) -> DataFrame:
    """Comparison rows of (metric, scope, value_old, value_new)."""
    return comparison_rows(rows.select(F.lit(axis).alias("axis"), "metric", "scope", "value_old", "value_new", F.lit(direction).alias("direction")))


def axis_rebuild(difference: DataFrame) -> DataFrame:
    """How far matched models were rebuilt: the mean share of changed net flags, and mean sizes of the cubes' changes; the old value is 0."""
    values = {"frac_netflag_changed": F.avg("frac_netflag_changed")} | {f"abs_delta_{c}": F.avg(F.abs(f"delta_{c}")) for c in ("poro", "permx", "ntg")}
    long = difference.agg(*(v.alias(n) for n, v in values.items())).withColumn("scope", F.lit("matched_seeds")).unpivot(["scope"], list(values), "metric", "value_new")
    return _axis("rebuild", long.withColumn("value_old", F.lit(0.0)), "~")


def axis_diversity(width: DataFrame) -> DataFrame:
    """Spreads of both experiments for each metric of geological_width_ratio."""
    return _axis("diversity", width.select(F.concat(F.lit("width_"), "metric").alias("metric"), F.lit("all").alias("scope"), F.col("spread_a").alias("value_old"), F.col("spread_b").alias("value_new")), "~")


def axis_misfit(misfit: DataFrame, old: str, new: str) -> DataFrame:
    """Mean total misfit of two setups for each cluster that both have."""
    g = misfit.groupBy("cluster_id").agg(*(F.avg(F.when(F.col("setup") == s, F.col("total_misfit"))).alias(n) for s, n in ((old, "value_old"), (new, "value_new"))))
    g = g.where("value_old is not null and value_new is not null")
    return _axis("history", g.select(F.lit("mean_total_misfit").alias("metric"), F.concat(F.lit("cluster_"), F.col("cluster_id").cast("string")).alias("scope"), "value_old", "value_new"), "<")


def axis_cross(rows: DataFrame, metrics: list[str], value: str = "total_misfit", by: str = "setup", old: str = "setup1", new: str = "setup2") -> DataFrame:
    """Correlation of the misfit with each geological metric, for both setups."""
    long = rows.select(by, value, *metrics).unpivot([by, value], metrics, "metric", "x")
    r = cross_axis(long, value, "x", [by, "metric"])
    g = r.groupBy("metric").agg(*(F.max(F.when(F.col(by) == s, F.col("r"))).alias(n) for s, n in ((old, "value_old"), (new, "value_new"))))
    return _axis("history", g.select(F.concat(F.lit("corr_misfit_"), "metric").alias("metric"), F.lit("all").alias("scope"), "value_old", "value_new"), "~")


def axis_production(uplift: DataFrame) -> DataFrame:
    """R2 of the parameters alone and with the geological predictors, for each response over all members."""
    rows = uplift.where("scope = 'all' and r2_base is not null")
    return _axis("production", rows.select(F.concat(F.lit("r2_"), "response").alias("metric"), "scope", F.col("r2_base").alias("value_old"), F.col("r2_full").alias("value_new")), ">")


def axis_correlations(corr: DataFrame) -> DataFrame:
    """Significant correlations as rows: the size of r is the new value, there is no old one."""
    none = F.lit(None).cast("double")
    return corr.where("significant").select(
        F.lit("production").alias("axis"), F.concat_ws(" ~ ", "predictor", "response").alias("metric"), F.lit("all").alias("scope"),
        none.alias("value_old"), F.abs("r").alias("value_new"), F.lit("~").alias("direction"), F.lit("SIGNIFICANT").alias("status"),
        none.alias("delta"), none.alias("ratio")
    )


def summary_comparison(axes: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, axes)


def histogram(rows: DataFrame, by: list[str], value: str = "value", bins: int = 15) -> DataFrame:
    """Counts of equal bins over each group's range; the last bin is closed."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    b = F.least(F.floor(F.coalesce(F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins) + 1, F.lit(bins)).cast("int")
    return rows.where(F.col(value).isNotNull()).withColumn("lo", lo).withColumn("hi", hi).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))


def box_plot(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    q = [F.percentile(value, F.lit(p)).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return rows.groupBy(*by).agg(*q, F.min(value).alias("low"), F.max(value).alias("high"))


def scaled_centroids(shift: DataFrame) -> DataFrame:
    """Centroids over max(|prior|, 1e-12), and the change in per cent (0 where the prior is nothing)."""
    p, q = F.col("prior_mean"), F.col("post_mean")
    size = F.greatest(F.abs(p), F.lit(1e-12))
    return shift.select(
        "cluster_id", "comp", (p / size).alias("prior_scaled"), (q / size).alias("post_scaled"),
        F.when(F.abs(p) > 1e-12, (q - p) / F.when(p != 0, p) * 100).otherwise(0.0).alias("shift_pct")
    )


def energy(singular: DataFrame, level: float = 0.99) -> DataFrame:
    """(k, s) with cumulative energy and the first k that reaches the level."""
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    t = singular.crossJoin(F.broadcast(singular.agg(F.sum(F.col("s") ** 2).alias("t"))))
    cum = t.withColumn("energy", F.sum(F.col("s") ** 2).over(w) / F.when(F.col("t") > 0, F.col("t"))).drop("t")
    return cum.withColumn("r", F.min(F.when(F.col("energy") >= level, F.col("k"))).over(Window.partitionBy()))


def latex_rows(table: DataFrame) -> DataFrame:
    """One line of a LaTeX table for each row (setup, phase, m_members, mean_width_ratio, mean_crps, coverage)."""
    line = F.format_string(
        "%s & %s & %d & %.3f & %.3e & %s \\\\", F.replace("setup", F.lit("_"), F.lit("\\_")), F.replace("phase", F.lit("_"), F.lit("\\_")),
        "m_members", "mean_width_ratio", "mean_crps",
        F.when(F.col("coverage").isNull() | F.isnan("coverage"), "--").otherwise(F.format_string("%.3f", "coverage"))
    )
    return table.select("setup", "phase", line.alias("line"))
