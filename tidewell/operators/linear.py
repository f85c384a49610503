"""Correlation, localization, ensemble update, distances, proxies and regressions.

Sums over members stay in Spark. Members, or positions if there are more of
them, are dealt over blocks, each a task's, whose triangular factors are merged
by a tree; only a matrix of the shorter side meets in one place, for a
decomposition. Members by positions never do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.columns import portable_order, portable_uniform, taper, verdict
from tidewell.operators import noise, regression
from tidewell.operators.series import KEY
from tidewell.sources import sinks


def correlation(theta: DataFrame, sim: DataFrame, keys=KEY) -> DataFrame:
    """Sample correlation of each component with each position, over members; 0 where one is constant."""
    z, d = theta.select("member_id", "comp", F.col("value").alias("z")), sim.select("member_id", *keys, F.col("value").alias("d"))
    r = F.try_divide(F.covar_samp("z", "d"), F.stddev_samp("z") * F.stddev_samp("d"))
    return z.join(d, "member_id").groupBy("comp", *keys).agg(F.coalesce(r, F.lit(0.0)).alias("r"), F.count("*").alias("n"))


def localization(corr: DataFrame, factor: float = 3.0, method: str = "hard", width: float = 0.1) -> DataFrame:
    """Add threshold (factor over the root of the members) and mask: 0 or 1, or a cosine taper for method soft."""
    if method not in ("hard", "soft"):
        raise ValueError(f"unknown method {method}")
    t = corr.withColumn("threshold", F.lit(float(factor)) / F.sqrt("n"))
    hard = F.when(F.abs("r") >= F.col("threshold"), 1.0).otherwise(0.0)
    return t.withColumn("mask", hard if method == "hard" else taper("r", F.col("threshold"), F.lit(float(width))))


def localization_summary(masked: DataFrame) -> DataFrame:
    return masked.agg(F.count_if(F.col("mask") > 0).alias("kept"), F.count("*").alias("total")).withColumn("percent", 100 * F.col("kept") / F.col("total"))


def truncated_svd(a: np.ndarray, energy: float = 0.99) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(u, s, vt, kept) for the fewest singular values whose squares reach the energy; none for a zero matrix."""
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    total = float(np.sum(s**2))
    if total <= 0:
        return u[:, :0], s[:0], vt[:0], 0.0
    cum = np.cumsum(s**2) / total
    r = min(int(np.searchsorted(cum, energy)) + 1, len(s))
    return u[:, :r], s[:r], vt[:r], float(cum[r - 1])


def matrix_rank(x: np.ndarray) -> int:
    s = np.linalg.svd(x, compute_uv=False)
    return int(np.sum(s > s.max(initial=0.0) * max(x.shape) * np.finfo(float).eps))


def _position(keys):
    return F.concat_ws("|", *(F.col(k).cast("string") for k in keys))


def position_blocks(sim: DataFrame, keys=KEY, block: int = 512, **constants) -> DataFrame:
    """(block, pos, ids, values, ...): one row a position with its members' ids and values in the order of the ids, and `constants`
    (aggregates); a block holds about `block` positions."""
    pair = F.array_sort(F.collect_list(F.struct("member_id", "value")))
    g = sim.groupBy(_position(keys).alias("pos")).agg(pair.alias("p"), *(c.alias(n) for n, c in constants.items()))
    # written once, as several passes read it
    g = sim.sparkSession.read.parquet(sinks.write_table(g, f"{sinks.scratch(sim.sparkSession, 'positions')}/blocks"))
    n = max(1, -(-g.count() // block))
    return g.select(
        F.pmod(F.xxhash64("pos"), F.lit(int(n))).alias("block"), "pos", F.col("p.member_id").alias("ids"), F.col("p.value").alias("values"),
        *constants
    )


def _centred(pdf: pd.DataFrame) -> np.ndarray:
    """Members by positions of a block, less the means, over the root of members less one."""
    d = np.stack(pdf["values"].to_numpy()).T if len(pdf) else np.empty((0, 0))
    return (d - d.mean(0)) / np.sqrt(max(len(d) - 1, 1))


def _summed(blocks: DataFrame, part) -> np.ndarray:
    """Sum over the blocks of the matrices that part(pdf) gives: rows are summed apart, so what is gathered is one matrix."""

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        m = part(pdf)
        return pd.DataFrame({"i": np.arange(len(m)), "row": list(m)})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "row": [np.sum(np.stack(pdf["row"].to_numpy()), 0)]})

    out = blocks.groupBy("block").applyInPandas(rows, "i long, row array<double>").groupBy("i").applyInPandas(total, "i long, row array<double>").collect()
    return np.array([r.row for r in sorted(out, key=lambda r: r.i)]) if out else np.empty((0, 0))


#: Triangular factors that one task merges.
MERGE = 8


def triangular(blocks: DataFrame, part, n_blocks: int) -> np.ndarray:
    """The triangular factor of the matrix whose rows part(pdf) gives for each block, by a tree of QR decompositions.

    A task decomposes one block, or MERGE stacked factors of the level before;
    what is gathered is the last factor, columns by columns. Unlike a sum of
    products with the transpose this doesn't square the condition. Each level is
    written, so a lost executor costs a task of it.
    """
    schema = "block long, i long, row array<double>"

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(part(pdf), mode="r")
        return pd.DataFrame({"block": int(pdf["block"].iloc[0]), "i": np.arange(len(r)), "row": list(r)})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.stack(pdf.sort_values(["block", "i"])["row"].to_numpy()), mode="r")
        return pd.DataFrame({"block": int(pdf["up"].iloc[0]), "i": np.arange(len(r)), "row": list(r)})

    spark = blocks.sparkSession
    level, folder, n = blocks.groupBy("block").applyInPandas(first, schema), sinks.scratch(spark, "factors"), n_blocks
    while n > 1:
        level = spark.read.schema(schema).parquet(sinks.write_table(level, f"{folder}/{n}"))
        level = level.withColumn("up", F.floor(F.col("block") / MERGE)).groupBy("up").applyInPandas(merge, schema)
        n = -(-n // MERGE)
    rows = sorted(level.collect(), key=lambda r: r.i)
    return np.array([r.row for r in rows]) if rows else np.empty((0, 0))


def member_blocks(sim: DataFrame, keys=KEY, block: int = 4096) -> tuple[DataFrame, list[str], int]:
    """((block, member_id, pos, values), positions, number of blocks): one row a member with its values, less the positions' means,
    over the root of members less one, in the order of the positions."""
    named = sim.select("member_id", _position(keys).alias("pos"), "value")
    stats = named.groupBy("pos").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    stats = sim.sparkSession.read.parquet(sinks.write_table(stats, f"{sinks.scratch(sim.sparkSession, 'means')}/means"))
    positions = sorted(r.pos for r in stats.select("pos").collect())  # columns of the triangular factor
    scaled = named.join(stats, "pos").select("member_id", "pos", ((F.col("value") - F.col("mean")) / F.sqrt(F.greatest(F.col("n") - 1, F.lit(1)))).alias("v"))
    rows = scaled.groupBy("member_id").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("p"))
    n = max(1, -(-named.select("member_id").distinct().count() // block))
    return rows.select(F.pmod(F.xxhash64("member_id"), F.lit(int(n))).alias("block"), "member_id", F.col("p.pos").alias("pos"), F.col("p.v").alias("values")), positions, n


def _numbered(blocks: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Blocks numbered without gaps: a hash can leave some empty."""
    have = sorted(r.block for r in blocks.select("block").distinct().collect()) if n > 1 else [0]
    if len(have) == n:
        return blocks, n
    place = F.create_map(*(F.lit(x).cast("long") for i, b in enumerate(have) for x in (b, i)))
    return blocks.withColumn("block", place[F.col("block")]), len(have)


def _shape(sim: DataFrame, keys) -> tuple[int, int]:
    """Members and positions."""
    r = sim.select(F.count_distinct("member_id").alias("m"), F.count_distinct(_position(keys)).alias("p")).first()
    return r.m, r.p


def by_members(sim: DataFrame, keys=KEY) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(positions, singular values, right singular vectors as rows) of the centred members-by-positions matrix over the root of
    members less one, for more members than positions: blocks of members are decomposed, and only positions by positions meet."""
    blocks, positions, n = member_blocks(sim, keys)
    blocks, n = _numbered(blocks, n)

    def part(pdf: pd.DataFrame) -> np.ndarray:
        if any(list(x) != positions for x in pdf["pos"]):
            raise ValueError("members or observations don't match")
        return np.stack(pdf["values"].to_numpy())

    r = triangular(blocks, part, n)
    _, s, vt = np.linalg.svd(r) if r.size else (None, np.empty(0), np.empty((0, len(positions))))
    return positions, s, vt[: len(s)]


def by_positions(blocks: DataFrame, part) -> tuple[np.ndarray, np.ndarray]:
    """(left singular vectors, singular values) of the same matrix for more positions than members: blocks of positions are decomposed, and members by members meet."""
    held, n = _numbered(blocks, 1 + (blocks.agg(F.max("block")).first()[0] or 0))
    r = triangular(held, lambda pdf: part(pdf).T, n)
    _, s, vt = np.linalg.svd(r) if r.size else (None, np.empty(0), np.empty((0, 0)))
    return vt[: len(s)].T, s


def _kept(s: np.ndarray, energy: float) -> int:
    total = float(np.sum(s**2))
    return min(int(np.searchsorted(np.cumsum(s**2) / total, energy)) + 1, len(s)) if total > 0 else 0


def singular_values(sim: DataFrame, energy: float = 0.99, keys=KEY) -> DataFrame:
    """(k, s, energy, kept) of the centred members-by-positions matrix over the root of members less one.

    The longer side is cut into blocks (members if there are more of them than
    positions), so a matrix of the shorter side alone meets in one place.
    """
    n, p = _shape(sim, keys)
    if n >= p:
        _, s, _ = by_members(sim, keys)
    else:
        _, s = by_positions(position_blocks(sim, keys), _centred)
    s = s[: min(n, p)]
    cum = np.cumsum(s**2) / max(float(np.sum(s**2)), 1e-300)
    r = _kept(s, energy)
    rows = [(k + 1, float(x), float(e), k < r) for k, (x, e) in enumerate(zip(s, cum, strict=True))]
    return sim.sparkSession.createDataFrame(rows, "k long, s double, energy double, kept boolean")


def component_rank(theta: DataFrame) -> DataFrame:
    """Rank of the centred members-by-components matrix, by its components-by-components covariance scaled to correlations."""
    comps = [r.comp for r in theta.select("comp").distinct().orderBy("comp").collect()]
    wide = theta.groupBy("member_id").pivot("comp", comps).agg(F.first("value"))
    pairs = [(i, j) for i in range(len(comps)) for j in range(i, len(comps))]
    row = wide.agg(F.count("*").alias("n"), *(F.covar_samp(f"`{comps[i]}`", f"`{comps[j]}`").alias(f"c{i}_{j}") for i, j in pairs)).first()
    c = np.zeros((len(comps), len(comps)))
    for i, j in pairs:
        c[i, j] = c[j, i] = row[f"c{i}_{j}"] or 0.0
    scale = np.sqrt(np.diag(c))
    scale[scale == 0] = 1.0
    w = np.linalg.eigvalsh(c / scale[:, None] / scale[None]) if len(comps) else np.empty(0)
    # squares of singular values, so the resolution is that of sums
    rank = int(np.sum(w > w.max(initial=0.0) * max(row.n, len(comps)) * np.finfo(float).eps * 16))
    return theta.sparkSession.createDataFrame([(rank, min(max(row.n - 1, 0), len(comps)))], "rank long, full long")


def perturbation(seed: int, *cols) -> F.Column:
    """A normal draw with deviation 1 that any engine shares: by the sine and cosine rule, from two uniform draws of seed and columns."""
    u, v = portable_uniform(seed, *cols), portable_uniform(seed + 1, *cols)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)


def perturbation_table(members: DataFrame, truth: DataFrame, seed: int = 42, keys=KEY) -> DataFrame:
    """(member_id, pos, eps): the draws of the update, made where they are used."""
    obs = truth.select(_position(keys).alias("pos"), "sigma")
    rows = members.select("member_id").distinct().crossJoin(F.broadcast(obs))  # the table of draws is this product
    return rows.select("member_id", "pos", (F.col("sigma") * perturbation(seed, "member_id", "pos")).alias("eps"))


def gain_matrix(z: np.ndarray, d: np.ndarray, sigma: np.ndarray, energy: float = 0.99, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(gain, all singular values, number kept) of the update in the ensemble's subspace, for a diagonal noise sigma^2.

    The products are ordered so that no observations-by-observations matrix is formed.
    """
    n = len(z)
    if n < 2 or len(d) != n or d.shape[1] != len(sigma):
        raise ValueError("members or observations don't match")
    zc, dc = z - z.mean(0), d - d.mean(0)
    _, all_s, _ = np.linalg.svd(dc / np.sqrt(n - 1), full_matrices=False)
    _, s, vt, _ = truncated_svd(dc / np.sqrt(n - 1), energy)
    inner = np.diag(s**2) + (vt * sigma**2) @ vt.T
    gain = (zc.T @ (dc @ vt.T) / (n - 1)) @ np.linalg.solve(inner, vt) if len(s) else np.zeros((z.shape[1], d.shape[1]))
    return gain * mask if mask is not None else gain, all_s, len(s)


def perturbations(sigma: np.ndarray, n: int, seed: int, covariance: np.ndarray | None = None) -> np.ndarray:
    """(n, observations) normal draws with the diagonal sigma^2, or with a full covariance by its Cholesky factor."""
    r = np.random.default_rng(seed)
    if covariance is None:
        return r.normal(0.0, 1.0, (n, len(sigma))) * sigma
    return r.normal(0.0, 1.0, (n, len(covariance))) @ np.linalg.cholesky(covariance + 1e-10 * np.eye(len(covariance))).T


def _long(matrix: np.ndarray, rows, cols, names: tuple[str, str, str]) -> pd.DataFrame:
    return pd.DataFrame({names[0]: np.repeat(np.asarray(rows), len(cols)), names[1]: np.tile(np.asarray(cols), len(rows)), names[2]: matrix.ravel()})


GAIN = "comp string, pos string, gain double"


def _significant(s: np.ndarray, energy: float, sizes: tuple[int, int]) -> int:
    """Values kept for an energy; those under the resolution of the decomposition have no direction of their own."""
    return min(_kept(s, energy), int(np.sum(s > s.max(initial=0.0) * max(sizes) * np.finfo(float).eps)))


def ensemble_gain(theta: DataFrame, sim: DataFrame, truth: DataFrame, energy: float = 0.99, keys=KEY, covariance: DataFrame | None = None) -> DataFrame:
    """(comp, pos, gain) of the update in the ensemble's subspace, for the noise R: diagonal by the truth's sigma, or in blocks by a covariance (see noise).

    With the centred members-by-positions matrix D and components matrix Z, both
    over the root of members less one: D = U S V', and the gain is
    Z' D V (S^2 + V' R V)^-1 V'. With more members than positions, S and V come
    from blocks of members, and Z' D is a table of covariances. Else U and S
    come from blocks of positions, V' R V is summed over them, and the gain's
    columns are made block by block.
    """
    keys = list(keys)
    obs = truth.select(*keys, "sigma")
    d = sim.select("member_id", *keys, "value").join(obs, keys)
    # written once, as several passes read it
    d = sim.sparkSession.read.parquet(sinks.write_table(d, f"{sinks.scratch(sim.sparkSession, 'gain')}/observed"))
    n, p = _shape(d, keys)
    if theta.select("member_id").distinct().count() < 2:
        raise ValueError("an update needs two members or more")
    if covariance is not None:
        covariance = noise.checked(covariance, d.select(_position(keys).alias("pos")).distinct())
    return (_gain_by_members if n >= p else _gain_by_positions)(theta, d, energy, keys, (n, p), covariance)


def _gain_by_members(theta: DataFrame, d: DataFrame, energy: float, keys: list[str], sizes: tuple[int, int], covariance: DataFrame | None) -> DataFrame:
    members = theta.select("member_id").distinct()
    if members.join(d.select("member_id").distinct(), "member_id").count() != max(members.count(), sizes[0]):
        raise ValueError("members or observations don't match")
    positions, s, vt = by_members(d, keys)
    r = _significant(s, energy, sizes)
    if r == 0:
        return theta.sparkSession.createDataFrame([], GAIN)
    v, at = vt[:r].T, {x: i for i, x in enumerate(positions)}
    if covariance is None:
        # a row a position, as in vt
        sigma = {x.pos: x.sigma for x in d.groupBy(_position(keys).alias("pos")).agg(F.max("sigma").alias("sigma")).collect()}
        rv = v * np.array([sigma[x] for x in positions])[:, None] ** 2
    else:
        # entries of positions by positions, which the triangular factor has as well
        c = covariance.select("pos_a", "pos_b", "cov").toPandas()
        rv = np.zeros_like(v)
        np.add.at(rv, c["pos_a"].map(at).to_numpy(), c["cov"].to_numpy()[:, None] * v[c["pos_b"].map(at).to_numpy()])
    right = np.linalg.solve(np.diag(s[:r] ** 2) + v.T @ rv, v.T)  # kept values by positions
    cross = theta.select("member_id", "comp", F.col("value").alias("z")).join(d.select("member_id", _position(keys).alias("pos"), "value"), "member_id")
    cross = cross.groupBy("comp", "pos").agg(F.covar_samp("z", "value").alias("c"))

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros(len(positions))
        c[[at[x] for x in pdf["pos"]]] = pdf["c"]
        return pd.DataFrame({"comp": pdf["comp"].iloc[0], "pos": positions, "gain": c @ v @ right})

    return cross.groupBy("comp").applyInPandas(columns, GAIN)


def _gain_by_positions(theta: DataFrame, d: DataFrame, energy: float, keys: list[str], sizes: tuple[int, int], covariance: DataFrame | None) -> DataFrame:
    blocks = position_blocks(d, keys, sigma=F.max("sigma"))
    ids = [r.member_id for r in theta.select("member_id").distinct().orderBy("member_id").collect()]
    wide = theta.select("member_id", "comp", "value").toPandas().pivot(index="member_id", columns="comp", values="value").sort_index()  # fewer members than positions
    comps, z = list(wide.columns), wide.to_numpy(float)
    z = (z - z.mean(0)) / np.sqrt(len(ids) - 1)

    def block(pdf: pd.DataFrame) -> np.ndarray:
        if any(list(x) != ids for x in pdf["ids"]):
            raise ValueError("members or observations don't match")
        return _centred(pdf)

    u, s = by_positions(blocks, block)
    r = _significant(s, energy, sizes)
    if r == 0:
        return theta.sparkSession.createDataFrame([], GAIN)
    back = u[:, :r] / s[:r]

    def diagonal(pdf: pd.DataFrame) -> np.ndarray:
        v = block(pdf).T @ back
        return (v * pdf["sigma"].to_numpy()[:, None] ** 2).T @ v

    def vectors(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"pos": pdf["pos"], "v": list(block(pdf).T @ back)})

    if covariance is None:
        inner = np.diag(s[:r] ** 2) + _summed(blocks, diagonal)
    else:
        inner = np.diag(s[:r] ** 2) + noise.quadratic(covariance, blocks.groupBy("block").applyInPandas(vectors, "pos string, v array<double>"), r)
    left = np.linalg.solve(inner.T, (z.T @ u[:, :r] * s[:r]).T).T  # components by kept values

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        return _long(left @ (block(pdf).T @ back).T, comps, pdf["pos"].to_numpy(), ("comp", "pos", "gain"))

    return blocks.groupBy("block").applyInPandas(columns, GAIN)


def ensemble_update(
    theta: DataFrame, sim: DataFrame, truth: DataFrame, mask: DataFrame | None = None, energy: float = 0.99, seed: int = 42,
    perturb: bool = True, keys=KEY, covariance: DataFrame | None = None
) -> DataFrame:
    """Posterior parameters (member_id, comp, comp_pos, value): the gain, masked, meets the innovations in a join.

    The noise of truth (d_obs, sigma) is diagonal, or has the covariance (block,
    pos_a, pos_b, cov); draws depend on seed, member and position.
    """
    keys = list(keys)
    pos = _position(keys).alias("pos")
    k = ensemble_gain(theta, sim, truth, energy, keys, covariance)
    if mask is not None:
        k = k.join(mask.select("comp", pos, "mask"), ["comp", "pos"]).select("comp", "pos", (F.col("gain") * F.col("mask")).alias("gain")).where("gain <> 0")
    eps = F.col("sigma") * perturbation(seed, "member_id", "pos") if perturb else F.lit(0.0)
    seen = sim.select("member_id", pos, "value").join(truth.select(pos, "d_obs", "sigma"), "pos")
    if perturb and covariance is not None:
        seen, eps = seen.join(noise.perturbations(seen.select("member_id", "pos"), covariance, seed), ["member_id", "pos"]), F.col("eps")
    inn = seen.select(
        "member_id", "pos", (F.col("d_obs") + eps - F.col("value")).alias("innovation")
    )
    step = inn.join(k, "pos").groupBy("member_id", "comp").agg(F.sum(F.col("gain") * F.col("innovation")).alias("step"))
    return theta.join(step, ["member_id", "comp"], "left").select(
        "member_id", "comp", "comp_pos", (F.col("value") + F.coalesce("step", F.lit(0.0))).alias("value")
    )


def update_two(theta: DataFrame, sim: DataFrame, truth: DataFrame, keys=KEY) -> DataFrame:
    """The update for exactly two observations at full energy and without perturbation, in closed form: no task but aggregations."""
    keys = list(keys)
    obs = truth.select(*keys, "d_obs", "sigma").withColumn("o", F.row_number().over(Window.orderBy(*keys)))
    d = sim.select("member_id", *keys, "value").join(F.broadcast(obs), keys)
    wide = d.groupBy("member_id").agg(
        *(
            F.max(F.when(F.col("o") == i, F.col(c))).alias(f"{n}{i}") for i in (1, 2) for c,
            n in (("value", "d"), ("d_obs", "y"), ("sigma", "s"))
        )
    )
    z = theta.select("member_id", "comp", "comp_pos", "value").join(wide, "member_id")
    g = z.groupBy("comp").agg(
        F.covar_samp("value", "d1").alias("c1"), F.covar_samp("value", "d2").alias("c2"), (F.var_samp("d1") + F.max("s1") ** 2).alias("a"),
        (F.var_samp("d2") + F.max("s2") ** 2).alias("b"), F.covar_samp("d1", "d2").alias("c")
    )
    det = F.col("a") * F.col("b") - F.col("c") * F.col("c")
    k = g.select(
        "comp", ((F.col("c1") * F.col("b") - F.col("c2") * F.col("c")) / det).alias("k1"),
        ((F.col("c2") * F.col("a") - F.col("c1") * F.col("c")) / det).alias("k2")
    )
    return z.join(k, "comp").select(
        "member_id", "comp",
        (F.col("value") + F.col("k1") * (F.col("y1") - F.col("d1")) + F.col("k2") * (F.col("y2") - F.col("d2"))).alias("value")
    )


def mahalanobis(prior: DataFrame, post: DataFrame, jitter: float = 1e-12) -> DataFrame:
    """(member_id, distance) under the prior's sample covariance. The covariance is aggregated in Spark; its inverse, components squared, is a literal."""
    comps = [r.comp for r in prior.select("comp").distinct().orderBy("comp").collect()]
    wide = prior.groupBy("member_id").pivot("comp", comps).agg(F.first("value"))
    row = wide.agg(*(F.covar_samp(f"`{a}`", f"`{b}`").alias(f"c{i}_{j}") for i, a in enumerate(comps) for j, b in enumerate(comps))).first()
    c = np.array([[row[f"c{i}_{j}"] or 0.0 for j in range(len(comps))] for i in range(len(comps))])
    inv = np.linalg.pinv(c + jitter * np.eye(len(comps)))
    shift = prior.select("member_id", "comp", F.col("value").alias("a")).join(
        post.select("member_id", "comp", F.col("value").alias("b")), ["member_id", "comp"]
    ).groupBy("member_id").pivot("comp", comps).agg(F.first(F.col("b") - F.col("a")))
    q = sum(((F.col(f"`{a}`") * F.col(f"`{b}`") * float(inv[i, j])) for i, a in enumerate(comps) for j, b in enumerate(comps)), F.lit(0.0))
    return shift.select("member_id", F.sqrt(F.greatest(q, F.lit(0.0))).alias("distance"))


PROXY = "cluster_id long, comp string, z_mean double, lo double, hi double, pos string, d_mean double, slope double, n_train long"


def build_proxies(theta: DataFrame, sim: DataFrame, ridge: float = 1e-8, keys=KEY) -> DataFrame:
    """One linear proxy a cluster of two members or more, long: slopes of each position on each component, means and envelope."""
    pos = F.concat_ws("|", *(F.col(k).cast("string") for k in keys))
    rows = theta.select("cluster_id", "member_id", F.lit("z").alias("what"), F.col("comp").alias("name"), "value").unionByName(
        sim.select("cluster_id", "member_id", F.lit("d").alias("what"), pos.alias("name"), "value")
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        cols = [c.split()[0] for c in PROXY.split(", ")]
        z = pdf[pdf.what == "z"].pivot(index="member_id", columns="name", values="value").sort_index()
        if len(z) < 2:
            return pd.DataFrame(columns=cols)
        d = pdf[pdf.what == "d"].pivot(index="member_id", columns="name", values="value").reindex(z.index)
        zc, dc = z.to_numpy() - z.to_numpy().mean(0), d.to_numpy() - d.to_numpy().mean(0)
        s = np.linalg.pinv(zc.T @ zc / (len(z) - 1) + ridge * np.eye(z.shape[1])) @ (zc.T @ dc / (len(z) - 1))
        out = _long(s, z.columns, d.columns, ("comp", "pos", "slope"))
        for c, v in (("z_mean", z.mean()), ("lo", z.min()), ("hi", z.max())):
            out[c] = out.comp.map(v)
        out["d_mean"], out["cluster_id"], out["n_train"] = out.pos.map(d.mean()), int(pdf.cluster_id.iloc[0]), len(z)
        return out[cols]

    return rows.groupBy("cluster_id").applyInPandas(fit, PROXY)


def predict(proxies: DataFrame, theta: DataFrame) -> DataFrame:
    """(member_id, pos, predicted, in_envelope); members of a cluster without proxy get one row of nulls, outside the envelope."""
    z = theta.select("member_id", "cluster_id", "comp", "value")
    inside = F.bool_and(F.col("value").between(F.col("lo"), F.col("hi")))
    rows = z.join(proxies, ["cluster_id", "comp"], "left")
    return rows.groupBy("member_id", "pos").agg(
        (F.max("d_mean") + F.sum((F.col("value") - F.col("z_mean")) * F.col("slope"))).alias("predicted"),
        F.coalesce(inside, F.lit(False)).alias("in_envelope")
    )


def simple_proxies(theta: DataFrame, sim: DataFrame, ridge: float = 1e-8, keys=KEY) -> DataFrame:
    """Proxies of one component by aggregation alone."""
    z = theta.select("member_id", "cluster_id", F.col("value").alias("z"))
    rows = z.join(sim.select("member_id", *keys, F.col("value").alias("d")), "member_id")
    g = rows.groupBy("cluster_id", *keys).agg(
        F.count("*").alias("n_train"), F.avg("z").alias("z_mean"), F.avg("d").alias("d_mean"), F.min("z").alias("lo"),
        F.max("z").alias("hi"), (F.covar_samp("z", "d") / (F.var_samp("z") + ridge)).alias("slope"), F.stddev_samp("d").alias("sigma")
    )
    return g.where("n_train >= 2")


def proxy_errors(theta: DataFrame, sim: DataFrame, split: DataFrame, ridge: float = 1e-8, keys=KEY) -> DataFrame:
    """(cluster_id, member_id, n_train, error) of held-out members: the proxies of all components, fitted on the training members, against
    the simulation. A member's error is the median over positions, each relative to the training members' deviation; one under 1 counts as 1."""
    keys = list(keys)
    tagged = theta.drop("split").join(split.select("member_id", "split"), "member_id")
    train, held = tagged.where("split = 'train'").drop("split"), tagged.where("split = 'val'").drop("split")
    cluster = theta.select("member_id", "cluster_id").distinct()
    rows = sim.select("member_id", *keys, "value").join(cluster, "member_id")
    seen = rows.join(train.select("member_id").distinct(), "member_id", "left_semi")
    fitted = build_proxies(train, seen, ridge, keys)
    spread = seen.groupBy("cluster_id", _position(keys).alias("pos")).agg(
        F.stddev_samp("value").alias("sigma"), F.count("*").alias("n_train")
    ).where("n_train >= 2")
    guess = predict(fitted, held).where("pos is not null").join(held.select("member_id", "cluster_id").distinct(), "member_id")
    true = rows.select("member_id", _position(keys).alias("pos"), "value")
    err = F.abs(F.col("predicted") - F.col("value")) / F.when(F.col("sigma") > 1, F.col("sigma")).otherwise(1.0)
    return guess.join(true, ["member_id", "pos"]).join(spread, ["cluster_id", "pos"]).groupBy("cluster_id", "member_id").agg(
        F.max("n_train").alias("n_train"), F.median(err).alias("error")
    )


def validate_proxy(theta: DataFrame, sim: DataFrame, split: DataFrame, ridge: float = 1e-8, keys=KEY, errors: DataFrame | None = None) -> DataFrame:
    """Hold-out errors of the proxies, per cluster and pooled (cluster -1), with a verdict."""
    member = errors if errors is not None else proxy_errors(theta, sim, split, ridge, keys)
    e = F.col("error")
    stats = [F.count("*").alias("n_val"), F.median(e).alias("median_rel_err"), F.avg(e).alias("mean_rel_err"), F.max(e).alias("max_rel_err")]
    out = member.groupBy("cluster_id").agg(*stats).unionByName(member.agg(*stats).withColumn("cluster_id", F.lit(-1).cast("long")))
    return out.withColumn("verdict", verdict("median_rel_err"))


def regression_r2(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """In-sample R2 of one predictor."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(F.pow(F.covar_samp(x, y), 2), F.var_samp(x) * F.var_samp(y)).alias("r2"))


def cross_validated_r2(rows: DataFrame, by: list[str], key: str, x: str, y: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Mean over k folds of the held-out R2 of one predictor; null for under 2k rows. Folds are dealt in an order any engine shares."""
    w = Window.partitionBy(*by)
    dealt = rows.withColumn(
        "fold", (F.row_number().over(w.orderBy(portable_order(seed, key), key)) - 1) % k
    ).withColumn("n", F.count("*").over(w)).where(F.col("n") >= 2 * k)
    folds = dealt.withColumn("out", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    m = folds.where("fold <> out").groupBy(*by, "out").agg(
        F.try_divide(F.covar_samp(x, y), F.var_samp(x)).alias("b"), F.avg(x).alias("mx"), F.avg(y).alias("my")
    )
    test = folds.where("fold = out").join(m, [*by, "out"])
    mean = F.avg(y).over(Window.partitionBy(*by, "out"))
    s = test.withColumn("e", (F.col(y) - F.col("my") - F.coalesce("b", F.lit(0.0)) * (F.col(x) - F.col("mx"))) ** 2).withColumn("t", (F.col(y) - mean) ** 2)
    return s.groupBy(*by, "out").agg((1 - F.try_divide(F.sum("e"), F.sum("t"))).alias("score")).groupBy(*by).agg(F.avg("score").alias("r2_cv"))


def r2_uplift(rows: DataFrame, group: str, base: list[str], extra: list[str], y: str, draws: int = 2000, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """Gain in R2 from the extra predictors; see regression.r2_uplift."""
    return regression.r2_uplift(rows, group, base, extra, y, draws, seed, key)


def src2(rows: DataFrame, group: str, predictors: list[str], y: str, draws: int = 2000, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """Squared standardised coefficients and the stability of their signs; see regression.src2."""
    return regression.src2(rows, group, predictors, y, draws, seed, key)


def bootstrap_means(rows: DataFrame, by: list[str], key: str, value: str, draws: int, seed: int) -> DataFrame:
    """2.5 and 97.5 percentiles of resampled means, by draws that any engine shares: draw i of replicate b is row floor(u * n).

    A group's values are one array (of members, so small); the draws index it, so no row is replicated.
    """
    held = rows.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v")))), lambda x: x["v"]).alias("vs")
    )
    one = held.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    pick = lambda i: F.element_at("vs", (F.floor(portable_uniform(seed, "b", i) * F.size("vs")) + 1).cast("int"))
    total = F.aggregate(F.sequence(F.lit(1), F.size("vs")), F.lit(0.0), lambda a, i: a + pick(i))
    means = one.select(*by, (total / F.size("vs")).alias("m"))
    return means.groupBy(*by).agg(F.percentile("m", F.lit(0.025)).alias("ci_low"), F.percentile("m", F.lit(0.975)).alias("ci_high"))
