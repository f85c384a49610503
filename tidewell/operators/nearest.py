"""Nearest cell centres of points, on grids whose cells differ much in size.

Centres are sorted along a curve that fills the plane and cut into leaves of
equally many, each with its bounding box: leaves are small where cells are. A
point first meets the leaf at its own place on the curve, which bounds how far
its nearest centres can be; then every other leaf whose box lies within that.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.geometry import holds
from tidewell.sources import sinks

#: Centres of a leaf, leaves at most (more centres make larger leaves), and points of a leaf that one task takes.
LEAF, MOST_LEAVES, A_TASK = 256, 100_000, 50_000
_SIDE = 1 << 20


def _spread_bits(v: np.ndarray) -> np.ndarray:
    """Bits of v at every second place."""
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | v << np.uint64(shift)) & np.uint64(mask)
    return v


def curve(x: np.ndarray, y: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Places on the curve; what lies outside the box (least and greatest x and y) counts as on its border."""
    at = [np.clip((v - lo) / max(hi - lo, 1e-300) * _SIDE, 0, _SIDE - 1).astype(np.int64) for v, lo, hi in ((x, *box[:2]), (y, *box[2:]))]
    return (_spread_bits(at[0]) | _spread_bits(at[1]) << np.uint64(1)).astype(np.int64)


def _coded(rows: DataFrame, x: str, y: str, box) -> DataFrame:
    schema = rows.schema.simpleString()[7:-1]

    def run(batches):
        for b in batches:
            code = curve(b.column(x).to_numpy(), b.column(y).to_numpy(), box)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code)], names=[*b.schema.names, "code"])

    return rows.mapInArrow(run, ", ".join(c.replace(":", " ", 1) for c in schema.split(",")) + ", code long")


def _in_leaves(visits: DataFrame, leaves: DataFrame, k: int) -> DataFrame:
    """(pid, d, id): the k nearest centres of each visited leaf (pid, x, y, leaf), as squares of distances. Points of a leaf are dealt over tasks."""
    parts = visits.groupBy(F.col("leaf").alias("_l")).agg(F.ceil(F.count("*") / A_TASK).cast("int").alias("parts"))
    dealt = visits.join(parts, F.col("leaf") == F.col("_l")).select("pid", "x", "y", "leaf", F.pmod(F.xxhash64("pid"), F.col("parts")).cast("int").alias("part"))
    copies = leaves.join(parts, F.col("leaf") == F.col("_l")).select("leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "cx", "cy")

    def one(points: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        centres = centres.sort_values("id")
        out, n = [], min(k, len(centres))
        for at in range(0, len(points), 4096):
            p = points.iloc[at : at + 4096]
            d = (p["x"].to_numpy()[:, None] - centres["cx"].to_numpy()) ** 2 + (p["y"].to_numpy()[:, None] - centres["cy"].to_numpy()) ** 2
            # by distance, then id
            near = np.argsort(d, 1, kind="stable")[:, :n]
            out.append(pd.DataFrame({"pid": np.repeat(p["pid"].to_numpy(), n), "d": np.take_along_axis(d, near, 1).ravel(), "id": centres["id"].to_numpy()[near].ravel()}))
        return pd.concat(out) if out and n else pd.DataFrame({"pid": [], "d": [], "id": []})

    return dealt.groupBy("leaf", "part").cogroup(copies.groupBy("leaf", "part")).applyInPandas(one, "pid long, d double, id long")


def nearest_centres(points: DataFrame, centres: DataFrame, k: int = 6, leaf: int = LEAF) -> DataFrame:
    """(pid, place, id): the k nearest of centres (id, cx, cy) of each point (pid, x, y), from place 0 on; equal distances go by id.

    pid and id are whole numbers and name one row each. Points or centres with a
    null coordinate have no neighbours.
    """
    spark, folder = points.sparkSession, sinks.scratch(points.sparkSession, "nearest")
    written = lambda df, name: spark.read.schema(df.schema).parquet(sinks.write_table(df, f"{folder}/{name}"))
    points = written(points.select("pid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(), "points")
    centres = centres.select("id", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy")).dropna()
    r = centres.agg(F.count("*"), F.min("cx"), F.max("cx"), F.min("cy"), F.max("cy")).first()
    if not r[0]:
        return spark.createDataFrame([], "pid long, place int, id long")
    box, size = tuple(r)[1:], max(leaf, k, -(-r[0] // MOST_LEAVES))

    def cut(batches):
        # leaves end with their partition: some are smaller, none larger
        n = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((n + np.arange(b.num_rows)) // size)], names=[*b.schema.names, "chunk"])
            n += b.num_rows

    ordered = _coded(centres, "cx", "cy", box).repartitionByRange("code", "id").sortWithinPartitions("code", "id").mapInArrow(cut, "id long, cx double, cy double, code long, chunk long")
    leaves = written(ordered.withColumn("leaf", F.spark_partition_id().cast("long") * 2**32 + F.col("chunk")), "leaves")
    boxes = leaves.groupBy("leaf").agg(*(f(c).alias(n) for n, f, c in (("code", F.min, "code"), ("x0", F.min, "cx"), ("x1", F.max, "cx"), ("y0", F.min, "cy"), ("y1", F.max, "cy"))), F.count("*").alias("n"))
    table = boxes.toArrow().sort_by([("code", "ascending"), ("leaf", "ascending")])  # MOST_LEAVES rows and a partition's rest at most
    sent = spark.sparkContext.broadcast({c: table.column(c).to_numpy() for c in table.column_names})

    def home(batches):
        t = sent.value
        for b in batches:
            at = np.maximum(np.searchsorted(t["code"], curve(b.column("x").to_numpy(), b.column("y").to_numpy(), box), side="right") - 1, 0)
            yield pa.RecordBatch.from_arrays([b.column("pid"), b.column("x"), b.column("y"), pa.array(t["leaf"][at])], names=["pid", "x", "y", "leaf"])

    first = written(points.mapInArrow(home, "pid long, x double, y double, leaf long"), "first")
    found = written(_in_leaves(first, leaves, k), "found")
    bound = found.groupBy(F.col("pid").alias("_p")).agg(F.max("d").alias("d"), F.count("*").alias("n"))
    bounded = first.join(bound.hint("merge"), F.col("pid") == F.col("_p"), "left").select("pid", "x", "y", "leaf", F.when(F.col("n") >= k, F.col("d")).otherwise(float("inf")).alias("d"))

    def others(batches, block=64):
        t = sent.value
        m = len(t["leaf"])
        starts = np.arange(0, m, block)
        outer = [f.reduceat(t[c], starts) for f, c in ((np.minimum, "x0"), (np.maximum, "x1"), (np.minimum, "y0"), (np.maximum, "y1"))]

        def gap(x, y, x0, x1, y0, y1):
            return np.maximum(np.maximum(x0 - x, x - x1), 0) ** 2 + np.maximum(np.maximum(y0 - y, y - y1), 0) ** 2

        for b in batches:
            pid, x, y, own, d = (b.column(c).to_numpy() for c in ("pid", "x", "y", "leaf", "d"))
            for at in range(0, len(pid), 512):
                cut_ = slice(at, at + 512)
                px, py, pd_ = x[cut_], y[cut_], d[cut_] * (1 + 1e-12)
                # blocks of leaves first, then their leaves
                i, g = np.nonzero(gap(px[:, None], py[:, None], *outer) <= pd_[:, None])
                i, j = np.repeat(i, block), (starts[g][:, None] + np.arange(block)).ravel()
                i, j = i[j < m], j[j < m]
                near = (gap(px[i], py[i], t["x0"][j], t["x1"][j], t["y0"][j], t["y1"][j]) <= pd_[i]) & (t["leaf"][j] != own[cut_][i])
                i, j = i[near], j[near]
                yield pa.RecordBatch.from_arrays([pa.array(pid[cut_][i]), pa.array(px[i]), pa.array(py[i]), pa.array(t["leaf"][j])], names=["pid", "x", "y", "leaf"])

    more = _in_leaves(written(bounded.mapInArrow(others, "pid long, x double, y double, leaf long"), "others"), leaves, k)
    near = found.union(more).groupBy("pid").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id"))), 1, k).alias("c"))  # k a visited leaf at most
    return near.select("pid", F.posexplode("c").alias("place", "c")).select("pid", "place", "c.id")


def locate_nearest(points: DataFrame, quads: DataFrame, k: int = 6, leaf: int = LEAF) -> DataFrame:
    """Add i, j of the first of the k cells with the nearest centres (i, j, x0..x3, y0..y3 in order around) that holds each point, null if none does."""
    spark, folder = points.sparkSession, sinks.scratch(points.sparkSession, "located")
    numbered = points.withColumn("pid", F.monotonically_increasing_id())
    numbered = spark.read.schema(numbered.schema).parquet(sinks.write_table(numbered, f"{folder}/points"))
    mid = lambda c: sum((F.col(f"{c}{n}") for n in range(4)), F.lit(0.0)) / 4
    # ids in the order of j and i, so that equal distances go by them
    cells = quads.withColumn("id", F.col("j").cast("long") * 2**31 + F.col("i"))
    near = nearest_centres(numbered.select("pid", "x", "y"), cells.select("id", mid("x").alias("cx"), mid("y").alias("cy")), k, leaf)
    # files of points and their neighbours hold many more rows than their size tells, so hints keep them off the driver
    tried = near.join(cells.hint("merge"), "id").join(numbered.select("pid", "x", "y").hint("merge"), "pid").where(holds())
    hit = tried.groupBy(F.col("pid").alias("_p")).agg(F.min(F.struct("place", "i", "j")).alias("c"))
    return numbered.join(hit.hint("merge"), F.col("pid") == F.col("_p"), "left").select(*points.columns, F.col("c.i").alias("i"), F.col("c.j").alias("j"))
