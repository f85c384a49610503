"""Parameters of members: quality checks, duplicates, ranking, choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.columns import portable_order


def state_vector(theta: DataFrame, controls: DataFrame | None = None, include_controls: bool = True) -> DataFrame:
    """Long state vector: parameters, then controls if given and wanted; positions run on."""
    out = theta.select("member_id", "comp", "comp_pos", "value", F.lit("theta").alias("block"))
    if controls is None or not include_controls:
        return out
    n = theta.agg(F.coalesce(F.max("comp_pos") + 1, F.lit(0)).alias("n"))
    u = controls.crossJoin(F.broadcast(n)).select(
        "member_id", "comp", (F.col("comp_pos") + F.col("n")).cast("int").alias("comp_pos"), "value", F.lit("control").alias("block")
    )
    return out.unionByName(u)


def pack(state: DataFrame) -> DataFrame:
    """(member_id, z): values in the order of their positions."""
    rows = F.array_sort(F.collect_list(F.struct("comp_pos", "value")))
    return state.groupBy("member_id").agg(rows.alias("r")).select("member_id", F.transform("r", lambda x: x["value"]).alias("z"))


def unpack(packed: DataFrame, blocks: dict[str, tuple[int, int]], width: int) -> DataFrame:
    """(member_id, block, pos, value) of the named slices; vectors of another width are an error."""
    checked = packed.withColumn("z", F.when(F.size("z") == width, F.col("z")).otherwise(F.raise_error(F.lit(f"a state vector is not {width} wide"))))
    parts = [
        checked.select("member_id", F.lit(b).alias("block"), F.posexplode(F.slice("z", start + 1, n)).alias("pos", "value")) for b,
        (start, n) in blocks.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def clip_to_prior(post: DataFrame, prior: DataFrame) -> DataFrame:
    """Values held to the prior's range of their component; clipped tells which were outside."""
    box = prior.groupBy("comp").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    v = F.col("value")
    return post.join(box, "comp").select(
        *(c for c in post.columns if c != "value"), F.least(F.greatest(v, F.col("lo")), F.col("hi")).alias("value"),
        ((v < F.col("lo")) | (v > F.col("hi"))).alias("clipped")
    )


def spread_retention(prior: DataFrame, post: DataFrame, collapse: float = 0.1, blowup: float = 1.5) -> DataFrame:
    """Standard deviations, their ratio (a prior of 0 counts as 1e-300) and flags, by component."""
    a = prior.groupBy("comp").agg(F.stddev_samp("value").alias("std_prior"))
    b = post.groupBy("comp").agg(F.stddev_samp("value").alias("std_post"))
    r = F.col("std_post") / F.when(F.col("std_prior") > 0, F.col("std_prior")).otherwise(F.lit(1e-300))
    return a.join(b, "comp").select("comp", "std_prior", "std_post", r.alias("ratio"), (r < collapse).alias("collapsed"), (r > blowup).alias("blown_up"))


def centroid_shift(prior: DataFrame, post: DataFrame) -> DataFrame:
    """Cluster means before and after, and the shift in units of the component's overall prior deviation."""
    keys = ["cluster_id", "comp"]
    a = prior.groupBy(*keys).agg(F.avg("value").alias("prior_mean"))
    b = post.groupBy(*keys).agg(F.avg("value").alias("post_mean"))
    s = prior.groupBy("comp").agg(F.stddev_samp("value").alias("sigma"))
    d = F.col("post_mean") - F.col("prior_mean")
    return a.join(b, keys).join(s, "comp").select(
        *keys, "prior_mean", "post_mean", d.alias("shift"), F.when(F.col("sigma") > 0, d / F.col("sigma")).alias("shift_sigma")
    )


def cluster_migration(prior: DataFrame, post: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Centroids of prior, posterior and reference, with three differences; nulls without a reference."""
    keys = ["cluster_id", "comp"]
    rows = prior.groupBy(*keys).agg(F.avg("value").alias("prior")).join(post.groupBy(*keys).agg(F.avg("value").alias("post")), keys)
    if reference is None:
        rows = rows.withColumn("reference", F.lit(None).cast("double"))
    else:
        rows = rows.join(reference.groupBy(*keys).agg(F.avg("value").alias("reference")), keys, "left")
    return rows.select(
        *keys, "prior", "post", "reference", (F.col("post") - F.col("prior")).alias("d_post_prior"),
        (F.col("prior") - F.col("reference")).alias("d_prior_reference"), (F.col("post") - F.col("reference")).alias("d_post_reference")
    )


def physical_bounds(prior: DataFrame, post: DataFrame) -> DataFrame:
    """Posterior values outside the prior's range, counted by component."""
    box = prior.groupBy("comp").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    rows = post.join(box, "comp").groupBy("comp", "lo", "hi").agg(
        F.min("value").alias("post_min"), F.max("value").alias("post_max"), F.count_if(F.col("value") < F.col("lo")).alias("n_below"),
        F.count_if(F.col("value") > F.col("hi")).alias("n_above")
    )
    return rows.withColumn("n_outside", F.col("n_below") + F.col("n_above"))


def duplicate_models(members: DataFrame, prior: DataFrame, post: DataFrame) -> DataFrame:
    """Models that occur more than once: mean shift of their members, distance of the first two posteriors, their ratio, clusters in order."""
    n = Window.partitionBy("model_id")
    dup = members.withColumn("n", F.count("*").over(n)).withColumn("r", F.row_number().over(n.orderBy("ord"))).where("n > 1")
    shift = prior.select("member_id", "comp", F.col("value").alias("a")).join(
        post.select("member_id", "comp", F.col("value").alias("b")), ["member_id", "comp"]
    ).groupBy("member_id").agg(F.sqrt(F.sum((F.col("b") - F.col("a")) ** 2)).alias("shift"))
    g = dup.join(shift, "member_id").groupBy("model_id").agg(
        F.count("*").alias("n_copies"), F.avg("shift").alias("mean_shift"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("ord", "cluster_id"))), lambda x: x["cluster_id"].cast("string")), ","
        ).alias("clusters")
    )
    val = post.select("member_id", "comp", "value")
    first = dup.where("r = 1").select("model_id", "member_id").join(val, "member_id").select("model_id", "comp", F.col("value").alias("a"))
    second = dup.where("r = 2").select("model_id", "member_id").join(val, "member_id").select("model_id", "comp", F.col("value").alias("b"))
    gap = first.join(second, ["model_id", "comp"]).groupBy("model_id").agg(F.sqrt(F.sum((F.col("a") - F.col("b")) ** 2)).alias("distance"))
    return g.join(gap, "model_id").select(
        "model_id", "n_copies", "mean_shift", "distance", (F.col("distance") / F.greatest(F.col("mean_shift"), F.lit(1e-9))).alias("ratio"),
        "clusters"
    )


def bimodality(rows: DataFrame, by: list[str]) -> DataFrame:
    """Bimodality coefficient from raw moments of z (sample deviation); 0 for under 4 rows or no spread."""
    w = Window.partitionBy(*by)
    z = rows.withColumn("_n", F.count("value").over(w)).withColumn("_s", F.stddev_samp("value").over(w)).withColumn(
        "_z", F.try_divide(F.col("value") - F.avg("value").over(w), F.col("_s"))
    )
    g = z.groupBy(*by).agg(F.max("_n").alias("n"), F.max("_s").alias("s"), F.avg(F.col("_z") ** 3).alias("skew"), (F.avg(F.col("_z") ** 4) - 3).alias("kurt"))
    n = F.col("n")
    denom = F.col("kurt") + F.try_divide(3 * (n - 1) * (n - 1), (n - 2) * (n - 3))
    ok = (n >= 4) & (F.col("s") > 0) & (denom > 0)
    return g.select(*by, F.when(ok, F.try_divide(F.col("skew") ** 2 + 1, denom)).otherwise(0.0).alias("bimodality"))


def deduplicate(members: DataFrame, prior: DataFrame, post: DataFrame) -> DataFrame:
    """One row for each model and component: posterior averaged over copies; prior, cluster and seed of the first copy; models by first appearance."""
    m = members.select("member_id", "model_id", "seed", F.col("cluster_id").alias("_c"), "ord")
    rows = prior.select("member_id", "comp", F.col("value").alias("prior")).join(
        post.select("member_id", "comp", F.col("value").alias("post")), ["member_id", "comp"]
    ).join(m, "member_id")
    return rows.groupBy("model_id", "comp").agg(
        F.avg("post").alias("theta_post"), F.min_by("prior", "ord").alias("theta_prior"), F.min_by("_c", "ord").alias("cluster_id"),
        F.min_by("seed", "ord").alias("seed"), F.min("ord").alias("first_ord"), (F.count("*") - 1).alias("n_collapsed")
    )


def in_envelope(theta: DataFrame, training: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(member_id, in_envelope): every component within the training rows' closed range, of the member's group if `by` is given."""
    by = by or []
    box = training.groupBy(*by, "comp").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    rows = theta.join(box, [*by, "comp"], "left")
    return rows.groupBy("member_id").agg(F.bool_and(F.coalesce(F.col("value").between(F.col("lo"), F.col("hi")), F.lit(False))).alias("in_envelope"))


def messages(
    spread: DataFrame, bounds: DataFrame, duplicates: DataFrame, rank: int, n_members: int, n_components: int, bimodal: float | None = None
) -> DataFrame:
    """(level, text) of the rules that fired."""
    s = spread.agg(F.count_if("collapsed").alias("c"), F.count_if("blown_up").alias("b"), F.count("*").alias("n"))
    full = min(n_members - 1, n_components)
    parts = [
        s.where("c > 0").select(F.lit("ERROR").alias("level"), F.concat(F.col("c").cast("string"), F.lit(" component(s) collapsed")).alias("text")),
        s.where("b * 2 > n").select(F.lit("WARN").alias("level"), F.concat(F.col("b").cast("string"), F.lit(" component(s) blew up")).alias("text")),
        bounds.agg(F.sum("n_outside").alias("o")).where("o > 0").select(F.lit("WARN").alias("level"), F.concat(F.col("o").cast("string"), F.lit(" value(s) outside the prior's range")).alias("text")),
        duplicates.agg(F.count("*").alias("d")).where("d > 0").select(F.lit("INFO").alias("level"), F.concat(F.col("d").cast("string"), F.lit(" model(s) occur more than once")).alias("text")),
    ]
    fixed = ([("WARN", f"rank {rank} is below {full}")] if rank < full else []) + (
        [("WARN", "the posterior looks bimodal")] if bimodal is not None and bimodal > 0.3 else []
    )
    if fixed:
        parts.append(spread.sparkSession.createDataFrame(fixed, "level string, text string"))
    return reduce(DataFrame.unionByName, parts)


def passed(msgs: DataFrame) -> DataFrame:
    return msgs.agg(F.coalesce(F.bool_and(F.col("level") != "ERROR"), F.lit(True)).alias("passed"))


def rank_members(distance: DataFrame, value: str = "distance") -> DataFrame:
    """rank 1 for the largest; ties go to the smaller ord."""
    return distance.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), "ord")))


def plan_resimulation(ranking: DataFrame, top_x: int, validation_n: int, seed: int) -> DataFrame:
    """Add role: resimulate for the first top_x ranks, else proxy; validate marks a stratified part of the proxy pool."""
    if "rank" not in ranking.columns:
        raise ValueError("the ranking has no rank")
    pool = ranking.where(F.col("rank") > top_x)
    chosen = stratified_choice(pool, validation_n, seed).select("member_id", F.lit(True).alias("validate"))
    return ranking.join(chosen, "member_id", "left").withColumn("validate", F.coalesce("validate", F.lit(False))).withColumn(
        "role", F.when(F.col("rank") <= top_x, "resimulate").otherwise("proxy")
    )


def stratified_choice(pool: DataFrame, n: int, seed: int) -> DataFrame:
    """n members in all: an equal quota for each cluster (the first clusters take the remainder), in a random order any engine shares; then the first n by ord."""
    k = pool.select("cluster_id").distinct().withColumn(
        "c", F.row_number().over(Window.orderBy("cluster_id"))
    ).withColumn("all", F.count("*").over(Window.partitionBy()))
    quota = F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("all"))) + F.when(F.col("c") <= F.pmod(F.lit(n), F.col("all")), 1).otherwise(0)
    order = Window.partitionBy("cluster_id").orderBy(portable_order(seed, "member_id"), "member_id")
    picked = pool.join(k, "cluster_id").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= quota)
    return picked.withColumn("_o", F.row_number().over(Window.orderBy("ord"))).where(F.col("_o") <= n).select(*pool.columns)


def stratified_split(members: DataFrame, frac: float, seed: int) -> DataFrame:
    """Add split: in each cluster max(1, round(n * frac)) members (half to even) are val, the rest train."""
    w = Window.partitionBy("cluster_id")
    order = w.orderBy(portable_order(seed, "member_id"), "member_id")
    n_val = F.greatest(F.lit(1), F.bround(F.count("*").over(w) * F.lit(frac)))
    return members.withColumn("split", F.when(F.row_number().over(order) <= n_val, "val").otherwise("train"))


def align(tables: dict[str, DataFrame], keys: list[str], value: str) -> DataFrame:
    """Full outer join of tables by their keys, one column each."""
    out = None
    for name, t in tables.items():
        t = t.select(*keys, F.col(value).alias(name))
        out = t if out is None else out.join(t, keys, "full")
    return out
