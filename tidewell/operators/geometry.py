"""Grids, wells and connected bodies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, by: list[str], order: list[str], state: str) -> DataFrame:
    """Gaps and islands: consecutive equal states of each group with first and last order value; null states make no run."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.when(F.lag(F.struct(state)).over(w).eqNullSafe(F.struct(state)), 0).otherwise(1)
    numbered = rows.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    o = order[0]
    return numbered.where(F.col(state).isNotNull()).groupBy(*by, "run", state).agg(F.count("*").alias("n"), F.min(o).alias("first"), F.max(o).alias("last"))


def perm_cutoff(cells: DataFrame, by: list[str], fallback: float = 0.0, least: int = 100, cap: float = 0.99, bins: int = 80) -> DataFrame:
    """(by, cutoff): right edge of the trough between the two highest peaks of the smoothed log-permeability histogram; the fallback without two peaks, with few cells, or above the cap quantile."""
    pos = cells.where("permx > 0").withColumn("lp", F.log10("permx"))
    s = pos.groupBy(*by).agg(F.count("*").alias("n"), F.min("lp").alias("lo"), F.max("lp").alias("hi"), F.percentile("permx", F.lit(cap)).alias("top"))
    b = F.least(F.floor(F.coalesce(F.try_divide(F.col("lp") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins) + 1, F.lit(bins)).cast("int")
    counts = pos.join(s, by).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("c"))
    full = s.select(*by, F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")).join(counts, [*by, "bin"], "left").fillna(0, ["c"])
    w = Window.partitionBy(*by).orderBy("bin")
    at = lambda n: F.coalesce((F.lag("c", -n) if n < 0 else F.lead("c", n)).over(w) if n else F.col("c"), F.lit(0))
    before = lambda n: F.coalesce(F.lag("c", n).over(w), F.lit(0))
    # fixed values: weights 1, 3, 5, 3, 1 over 13
    smooth = full.withColumn("s", (before(2) + 3 * before(1) + 5 * F.col("c") + 3 * at(1) + at(2)) / F.lit(13.0))
    peaks = smooth.withColumn("p", F.lag("s").over(w)).withColumn("q", F.lead("s").over(w)).where("p is not null and q is not null and s >= p and s >= q")
    two = peaks.withColumn(
        "_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("s"), "bin"))
    ).where("_r <= 2").groupBy(*by).agg(F.min("bin").alias("a"), F.max("bin").alias("b"), F.count("*").alias("m")).where("m = 2")
    trough = smooth.join(two, by).where("bin between a and b").groupBy(*by).agg(F.min_by("bin", F.struct("s", "bin")).alias("t"))
    cut = F.pow(F.lit(10.0), F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("t") / bins)
    out = cells.select(*by).distinct().join(s, by, "left").join(trough, by, "left").withColumn("cut", cut)
    return out.select(
        *by,
        F.when(
            (F.col("n") >= least) & F.col("cut").isNotNull() & (F.col("cut") <= F.col("top")), F.col("cut")
        ).otherwise(float(fallback)).alias("cutoff")
    )


OFFSETS = {6: [(1, 0, 0), (0, 1, 0), (0, 0, 1)], 26: [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (c, b, a) > (0, 0, 0)]}


def offsets(connectivity: int) -> Column:
    """A row for each half of the directions, a struct (di, dj, dk)."""
    return F.explode(F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(c).alias("dk")) for a, b, c in OFFSETS[connectivity])))


def body_edges(mask: DataFrame, connectivity: int) -> DataFrame:
    """(model, a, b): flat indices of neighbouring cells of the mask (model, flat, i, j, k), half of all directions."""
    if connectivity not in OFFSETS:
        raise ValueError(f"connectivity {connectivity} is neither 6 nor 26")
    near = mask.select("model", F.col("flat").alias("a"), "i", "j", "k", offsets(connectivity).alias("o")).select(
        "model", "a", (F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"),
        (F.col("k") + F.col("o.dk")).alias("k")
    )
    return near.join(mask.select("model", F.col("flat").alias("b"), "i", "j", "k"), ["model", "i", "j", "k"]).select("model", "a", "b")


def label_bodies(mask: DataFrame, connectivity: int = 26) -> DataFrame:
    """(model, flat, i, j, k, body): connected bodies of each model, numbered from 1 by their first cell in scan order.

    A model's grid has a fixed size, so its cells meet in one task, where a
    vectorised union of neighbours runs in time near the number of cells.
    """
    cells = mask.select(F.col("model").cast("long").alias("model"), F.col("flat").cast("long").alias("flat"), "i", "j", "k")
    return labelled(cells, ["model"], connectivity).drop("label")


def labelled(cells: DataFrame, by: list[str], connectivity: int) -> DataFrame:
    """Add body, numbered from 1 within each group of `by`, and label, the body's smallest flat, to cells (by, flat, i, j, k).

    Groups follow each other in a task, and those of a batch are labelled at
    once: a task holds a batch and one group, and small groups cost no call each.
    """
    if connectivity not in OFFSETS:
        raise ValueError(f"connectivity {connectivity} is neither 6 nor 26")

    def starts(pdf: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(pdf), bool)
        new[0] = True
        for c in by:
            v, before = pdf[c], pdf[c].shift()
            new |= ((v != before) & ~(v.isna() & before.isna())).to_numpy()
        return new

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        new = starts(pdf)
        group = np.cumsum(new) - 1
        parent = united(group, pdf[["i", "j", "k"]].to_numpy(np.int64), connectivity)
        _, body = np.unique(parent, return_inverse=True)
        return pdf.assign(body=body - body[np.nonzero(new)[0]][group] + 1, label=pdf["flat"].to_numpy()[parent])

    def run(batches):
        held = []
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pd.concat([held[-1].iloc[-1:], pdf]) if held else pdf
            new = starts(pdf)
            new[0] = False
            last = np.nonzero(new)[0][-1] if new.any() else 0
            own = 1 if held else 0
            if last:
                yield label(pd.concat([*held, pdf.iloc[own:last]], ignore_index=True))
                held, own = [], last
            held.append(pdf.iloc[own:])
        if held:
            yield label(pd.concat(held, ignore_index=True))

    schema = ", ".join(f"{c} {kind}" for c, kind in cells.dtypes)
    return cells.repartition(*by).sortWithinPartitions(*by, "flat").mapInPandas(run, f"{schema}, body long, label long")


def united(group: np.ndarray, ijk: np.ndarray, connectivity: int) -> np.ndarray:
    """For each cell the place of the first cell of its body; only cells of one group touch."""
    size = ijk.max(0) + 3
    code = lambda x: ((group * size[2] + x[:, 2] + 1) * size[1] + x[:, 1] + 1) * size[0] + x[:, 0] + 1
    own = code(ijk)
    order = np.argsort(own)
    ordered, parent = own[order], np.arange(len(own))
    pairs = []
    for o in OFFSETS[connectivity]:
        other = code(ijk + np.array(o))
        at = np.minimum(np.searchsorted(ordered, other), len(own) - 1)
        hit = ordered[at] == other
        pairs.append(np.stack([np.nonzero(hit)[0], order[at[hit]]], 1))
    edges = np.concatenate(pairs)
    while len(edges):
        low = np.minimum(parent[edges[:, 0]], parent[edges[:, 1]])
        before = parent.copy()
        np.minimum.at(parent, parent[edges[:, 0]], low)
        np.minimum.at(parent, parent[edges[:, 1]], low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        if (before == parent).all():
            break
    return parent


def label_bodies_spread(mask: DataFrame, connectivity: int = 26, rounds: int = 200) -> DataFrame:
    """As label_bodies, for grids that no task can hold: labels shrink over neighbour joins, each round written by checkpoint()."""
    e = body_edges(mask, connectivity)
    both = e.union(e.select("model", F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    lab = mask.select("model", "flat", F.col("flat").alias("l"))
    total = None
    for _ in range(rounds):
        near = both.join(
            lab.select("model", F.col("flat").alias("b"), "l"), ["model", "b"]
        ).groupBy("model", F.col("a").alias("flat")).agg(F.min("l").alias("n"))
        lab = lab.join(near, ["model", "flat"], "left").select("model", "flat", F.least("l", F.coalesce("n", "l")).alias("l"))
        jump = lab.select("model", F.col("flat").alias("l"), F.col("l").alias("up"))
        lab = lab.join(jump, ["model", "l"], "left").select("model", "flat", F.least("l", F.coalesce("up", "l")).alias("l")).checkpoint()
        now = lab.agg(F.sum("l")).first()[0]
        if now == total:
            break
        total = now
    body = F.dense_rank().over(Window.partitionBy("model").orderBy("l")).cast("long")
    return lab.select("model", "flat", body.alias("body"))


def principal_axes(rows: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Major and minor axis (2 root lambda of the sample covariance) and the angle in (-90, 90]; zeros under 2 points."""
    g = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("a"), F.coalesce(F.var_samp(y), F.lit(0.0)).alias("c"),
        F.coalesce(F.covar_samp(x, y), F.lit(0.0)).alias("b")
    )
    mid, root = (F.col("a") + F.col("c")) / 2, F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, 2) + F.pow("b", 2))
    angle = F.degrees(F.lit(0.5) * F.atan2(2 * F.col("b"), F.col("a") - F.col("c")))
    ok = F.col("n") >= 2
    return g.select(
        *by, F.when(ok, 2 * F.sqrt(F.greatest(mid + root, F.lit(0.0)))).otherwise(0.0).alias("major"),
        F.when(ok, 2 * F.sqrt(F.greatest(mid - root, F.lit(0.0)))).otherwise(0.0).alias("minor"),
        F.when(ok, F.when(angle <= -90, 90.0).otherwise(angle)).otherwise(0.0).alias("angle")
    )


def body_stats(labels: DataFrame, most: int | None = None) -> DataFrame:
    """Cells, extents, anisotropy and plan orientation of each body, the largest first (ties by number), `most` of each model at most."""
    ext = lambda c: (F.max(c) - F.min(c) + 1).cast("long")
    g = labels.groupBy("model", "body").agg(F.count("*").alias("n_cells"), ext("i").alias("extent_i"), ext("j").alias("extent_j"), ext("k").alias("extent_k"))
    e = [F.col(f"extent_{c}") for c in "ijk"]
    axes = principal_axes(labels, ["model", "body"], "i", "j")
    rank = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("n_cells"), "body"))
    out = g.join(axes, ["model", "body"]).withColumn("anisotropy", F.greatest(*e) / F.least(*e)).withColumn("rank", rank)
    return out if most is None else out.where(F.col("rank") <= most)


def sand_fractions(stats: DataFrame) -> DataFrame:
    n = F.col("n_cells")
    return stats.groupBy("model").agg(
        F.count("*").alias("n_bodies"), F.try_divide(F.sum(F.when(F.col("rank") == 1, n).otherwise(0)), F.sum(n)).alias("frac_largest"),
        F.try_divide(F.sum(F.when(F.col("rank") <= 10, n).otherwise(0)), F.sum(n)).alias("frac_top10")
    )


def well_pairs(well_cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(model, a, b): pairs of wells with a < b that meet a body in common."""
    hits = well_cells.join(labels, ["model", "i", "j", "k"]).select("model", "well", "body").distinct()
    a, b = hits.select("model", "body", F.col("well").alias("a")), hits.select("model", "body", F.col("well").alias("b"))
    return a.join(b, ["model", "body"]).where("a < b").select("model", "a", "b").distinct()


def injector_connections(wells: DataFrame, pairs: DataFrame) -> DataFrame:
    """By model: producers, injectors, and how many injectors each producer meets (mean, max, count over 0). Injectors' names begin with INJ."""
    inj = lambda c: F.upper(F.substring(c, 1, 3)) == "INJ"
    w = wells.select("model", "well").distinct()
    both = pairs.union(
        pairs.select("model", F.col("b"), F.col("a"))
    ).where(~inj(F.col("a")) & inj(F.col("b"))).groupBy("model", F.col("a").alias("well")).agg(F.count("*").alias("n"))
    prod = w.where(~inj(F.col("well"))).join(both, ["model", "well"], "left").fillna(0, ["n"])
    out = prod.groupBy("model").agg(
        F.count("*").alias("n_producers"), F.avg("n").alias("mean_connections"), F.max("n").alias("max_connections"),
        F.count_if(F.col("n") > 0).alias("n_connected")
    )
    return out.join(w.groupBy("model").agg(F.count_if(inj(F.col("well"))).alias("n_injectors")), "model")


def deck_connectivity(mask: DataFrame, well_cells: DataFrame) -> DataFrame:
    """One row a model of the mask (model, flat, i, j, k) or the wells (model, well, i, j, k): number of bodies and shares of sand in
    the largest at both connectivities, shape of the largest, and how many injectors each producer meets through a body."""
    labels = label_bodies(mask, 26)
    s26, s6 = body_stats(labels), body_stats(label_bodies(mask, 6))
    wide = sand_fractions(s26).select(
        "model", F.col("n_bodies").alias("n_bodies_26"), F.col("frac_largest").alias("frac_sand_in_largest_26"),
        F.col("frac_top10").alias("frac_sand_in_top10_26")
    )
    six = sand_fractions(s6).select("model", F.col("n_bodies").alias("n_bodies_6"), F.col("frac_largest").alias("frac_sand_in_largest_6"))
    top = s26.where("rank = 1").select(
        "model", F.col("n_cells").alias("top1_n_cells"), F.col("anisotropy").alias("top1_anisotropy"),
        F.col("angle").alias("top1_orientation_deg")
    )
    inj = F.upper(F.substring("well", 1, 3)) == "INJ"
    wells = well_cells.select("model", "well").distinct().groupBy("model").agg(F.count_if(~inj).alias("n_producers"), F.count_if(inj).alias("n_injectors"))
    met = injector_connections(well_cells, well_pairs(well_cells, labels)).select(
        "model", F.col("mean_connections").alias("mean_inj_connections_per_producer"),
        F.col("max_connections").alias("max_inj_connections_per_producer"), F.col("n_connected").alias("n_producers_connected_to_any_inj")
    )
    out = mask.select("model").union(well_cells.select("model")).distinct()
    for t in (wide, six, top, wells, met):
        out = out.join(t, "model", "left")
    return out.fillna(0, [c for c in out.columns if c != "model"])


def sample_track(tracks: DataFrame, step: float = 0.5) -> DataFrame:
    """(model, well, s, md, x, y, z): points at equal measured depths along each track (model, well, seq, x, y, z, md), linear between survey points; tracks of under 2 points or no length give none."""
    track = Window.partitionBy("model", "well")
    w = track.orderBy("seq")
    box = {"m": F.count("*").over(track), "md0": F.min_by("md", "seq").over(track), "md1": F.max_by("md", "seq").over(track)}
    seg = tracks.where("model is not null and well is not null").withColumns(
        {f"{c}2": F.lead(c).over(w) for c in ("x", "y", "z", "md")} | box
    ).where("m >= 2 and md1 > md0 and md2 >= md").withColumn(
        "n", F.greatest(F.lit(2), (F.ceil((F.col("md1") - F.col("md0")) / step) + 1).cast("int"))
    )
    # each segment makes its own samples, and one more at each end that is tried: nothing is joined
    place = lambda c: (F.col(c) - F.col("md0")) / (F.col("md1") - F.col("md0")) * (F.col("n") - 1)
    lo = F.greatest(F.floor(place("md")) - 1, F.lit(0)).cast("int")
    hi = F.least(F.ceil(place("md2")) + 1, F.col("n") - 1).cast("int")
    points = seg.withColumn("s", F.explode(F.when(lo <= hi, F.sequence(lo, hi)))).withColumn(
        "at",
        F.when(F.col("s") == F.col("n") - 1, F.col("md1")).otherwise(
            F.col("md0") + (F.col("md1") - F.col("md0")) * F.col("s") / (F.col("n") - 1)
        )
    )
    hit = points.where("at >= md and at <= md2")
    t = F.coalesce(F.try_divide(F.col("at") - F.col("md"), F.col("md2") - F.col("md")), F.lit(0.0))
    one = hit.withColumn("_r", F.row_number().over(Window.partitionBy("model", "well", "s").orderBy("seq"))).where("_r = 1")
    return one.select("model", "well", "s", F.col("at").alias("md"), *((F.col(c) + (F.col(f"{c}2") - F.col(c)) * t).alias(c) for c in ("x", "y", "z")))


def holds():
    """Whether the corners x0..x3, y0..y3, in order around a cell, go around the point x, y or touch it."""
    cross = [
        (F.col(f"x{(n + 1) % 4}") - F.col(f"x{n}")) * (F.col("y") - F.col(f"y{n}")) - (
            F.col(f"y{(n + 1) % 4}") - F.col(f"y{n}")
        ) * (F.col("x") - F.col(f"x{n}")) for n in range(4)
    ]
    return (F.least(*cross) >= 0) | (F.greatest(*cross) <= 0)


#: Points of a square that one task takes.
A_SQUARE = 100_000


def locate(points: DataFrame, quads: DataFrame, size: float) -> DataFrame:
    """Add i, j of the plan cell (i, j, x0..x3, y0..y3 in order around it) that holds each point, null if none.

    Cells are entered in every square of the given size that their bounding box
    touches, so a point meets only the cells of its own square; of several
    holders the one with the nearest centre wins.
    """
    xs, ys = [f"x{n}" for n in range(4)], [f"y{n}" for n in range(4)]
    span = lambda cols: F.sequence(F.floor(F.least(*cols) / size), F.floor(F.greatest(*cols) / size))
    cells = quads.withColumn("bx", F.explode(span(xs))).withColumn("by", F.explode(span(ys)))
    p = points.withColumns({"_id": F.monotonically_increasing_id(), "bx": F.floor(F.col("x") / size), "by": F.floor(F.col("y") / size)})
    # wells stand close, so the points of a square are dealt over tasks
    parts = p.groupBy("bx", "by").agg(F.ceil(F.count("*") / A_SQUARE).cast("int").alias("parts"))
    p = p.join(parts, ["bx", "by"], "left").withColumn("part", F.pmod("_id", "parts").cast("int")).alias("p")
    cells = cells.join(parts, ["bx", "by"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    mid = lambda cols: sum((F.col(c) for c in cols), F.lit(0.0)) / 4
    near = F.pow(F.col("x") - mid(xs), 2) + F.pow(F.col("y") - mid(ys), 2)
    # cells are more than what they are exploded from, so the hint keeps them off the driver
    c = cells.hint("merge").alias("c")
    met = p.join(c, (F.col("p.bx") == F.col("c.bx")) & (F.col("p.by") == F.col("c.by")) & (F.col("p.part") == F.col("c.part")) & holds(), "left")
    hit = F.min(F.when(F.col("c.bx").isNotNull(), F.struct(near.alias("d"), "j", "i"))).alias("c")
    return met.groupBy("_id", *points.columns).agg(hit).select(*points.columns, F.col("c.i").alias("i"), F.col("c.j").alias("j"))


def bracket(points: DataFrame, layers: DataFrame) -> DataFrame:
    """Add k: the first layer (i, j, k, z_top, z_bot) of the point's column with z_top <= z <= z_bot, null if none."""
    p, c = points.withColumn("_id", F.monotonically_increasing_id()).alias("p"), layers.hint("merge").alias("c")
    met = p.join(c, (F.col("p.i") == F.col("c.i")) & (F.col("p.j") == F.col("c.j")) & F.col("p.z").between(F.col("c.z_top"), F.col("c.z_bot")), "left")
    return met.groupBy("_id", *(F.col(f"p.{n}") for n in points.columns)).agg(F.min("k").alias("k")).drop("_id")


def perforated(spans: DataFrame, perfs: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Add perforated: a run (md_in, md_out) overlaps an interval of its well by more than eps; wells without intervals are perforated throughout."""
    # the few intervals of a well lie in its row, so spans are neither copied nor grouped again
    known = perfs.groupBy("model", "well").agg(F.collect_list(F.struct("md_low", "md_high")).alias("_intervals"))
    lo, hi = F.least("md_in", "md_out"), F.greatest("md_in", "md_out")
    hit = F.exists("_intervals", lambda p: F.greatest(lo, p["md_low"]) + eps < F.least(hi, p["md_high"]))
    return spans.join(known, ["model", "well"], "left").select(
        *spans.columns, (F.col("_intervals").isNull() | F.coalesce(hit, F.lit(False))).alias("perforated")
    )


def traverse(tracks: DataFrame, quads: DataFrame, layers: DataFrame, perfs: DataFrame, step: float = 0.5, size: float = 100.0) -> DataFrame:
    """Cells along each well: one row for each unbroken run in a cell, with thickness between the run's first and last sample."""
    at = bracket(locate(sample_track(tracks, step), quads, size), layers)
    cell = F.when(F.col("k").isNotNull(), F.struct("i", "j", "k"))
    w = Window.partitionBy("model", "well").orderBy("s")
    rows = at.withColumn("cell", cell).withColumn(
        "_c", F.when(F.lag("cell").over(w).eqNullSafe(F.col("cell")) & (F.row_number().over(w) > 1), 0).otherwise(1)
    ).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = rows.where("cell is not null").groupBy("model", "well", "run", "i", "j", "k").agg(
        F.min("md").alias("md_in"), F.max("md").alias("md_out"), F.abs(F.max_by("z", "s") - F.min_by("z", "s")).alias("dz_eff")
    )
    return perforated(g, perfs)


def grid_quads(pillars: DataFrame) -> DataFrame:
    """Plan cells from pillar tops (j, i, x, y): corners in order around each cell, and the centre."""
    p = lambda n, di, dj: pillars.select(
        (F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}")
    )
    q = p(0, 0, 0)
    for n, di, dj in ((1, 1, 0), (2, 1, 1), (3, 0, 1)):
        # files of whole numbers say little of how many rows they have, so the hint keeps pillars off the driver
        q = q.join(p(n, di, dj).hint("merge"), ["i", "j"])
    return q.withColumn("cx", (F.col("x0") + F.col("x1") + F.col("x2") + F.col("x3")) / 4).withColumn(
        "cy", (F.col("y0") + F.col("y1") + F.col("y2") + F.col("y3")) / 4
    )


def layers_from_zcorn(zcorn: DataFrame, nx: int, ny: int) -> DataFrame:
    """(i, j, k, z_top, z_bot) from corner depths (pos, z) in the order k, top/bottom, j, south/north, i, west/east: means of four corners."""
    p = F.col("pos")
    i, rest = F.floor(p % (2 * nx) / 2), F.floor(p / (2 * nx))
    j, rest2 = F.floor(rest % (2 * ny) / 2), F.floor(rest / (2 * ny))
    g = zcorn.select(
        i.cast("int").alias("i"), j.cast("int").alias("j"), F.floor(rest2 / 2).cast("int").alias("k"), (rest2 % 2).alias("side"), "z"
    ).groupBy("i", "j", "k")
    return g.agg(F.avg(F.when(F.col("side") == 0, F.col("z"))).alias("z_top"), F.avg(F.when(F.col("side") == 1, F.col("z"))).alias("z_bot"))
