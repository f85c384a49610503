"""Connected bodies of grids that no task holds: blocks are labelled apart, and labels that meet at a border are joined."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.geometry import OFFSETS, labelled, offsets
from tidewell.sources import sinks

#: Cells of a block along i, j and k: 65,536 at most in one task.
BLOCK = (64, 64, 16)
#: Joined labels of a model that one task settles; beyond that they shrink over joins.
MOST_EDGES = 1_000_000


def _written(df: DataFrame, folder: str, name: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(sinks.write_table(df, f"{folder}/{name}"))


def block_labels(mask: DataFrame, connectivity: int, block: tuple[int, int, int]) -> DataFrame:
    """(model, flat, i, j, k, block, label): each cell's smallest flat index of its body within the block."""
    at = [F.floor(F.col(c) / n) for c, n in zip("ijk", block, strict=True)]
    placed = mask.select("model", F.col("flat").cast("long").alias("flat"), "i", "j", "k", F.concat_ws("/", *(a.cast("string") for a in at)).alias("block"))
    return labelled(placed, ["model", "block"], connectivity).select("model", "flat", "i", "j", "k", "block", "label")


def border_links(cells: DataFrame, connectivity: int, block: tuple[int, int, int]) -> DataFrame:
    """(model, a, b): labels that touch over a border between blocks, a > b. Only cells at borders are joined, with neighbours in other blocks."""
    edge, other = F.lit(False), F.lit(False)
    for c, n in zip("ijk", block, strict=True):
        edge = edge | (F.pmod(c, F.lit(n)) == 0) | (F.pmod(c, F.lit(n)) == n - 1)
        other = other | (F.floor((F.col(c) + F.col(f"o.d{c}")) / n) != F.floor(F.col(c) / n))
    border = cells.where(edge).select("model", "i", "j", "k", "label")
    near = border.withColumn("o", offsets(connectivity)).where(other).select("model", *((F.col(c) + F.col(f"o.d{c}")).alias(c) for c in "ijk"), F.col("label").alias("near"))
    met = near.join(border.hint("merge"), ["model", "i", "j", "k"]).where("near <> label")
    return met.select("model", F.greatest("near", "label").alias("a"), F.least("near", "label").alias("b")).distinct()


def _settled_in_tasks(links: DataFrame) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, back = np.unique(pdf[["a", "b"]].to_numpy().ravel(), return_inverse=True)
        edges, parent = back.reshape(-1, 2), np.arange(len(nodes))
        while True:
            low = np.minimum(parent[edges[:, 0]], parent[edges[:, 1]])
            before = parent.copy()
            for side in (0, 1):
                np.minimum.at(parent, parent[edges[:, side]], low)
                np.minimum.at(parent, edges[:, side], low)
            while (parent[parent] != parent).any():
                parent = parent[parent]
            if (before == parent).all():
                break
        return pd.DataFrame({"model": pdf["model"].iloc[0], "label": nodes, "root": nodes[parent]})

    kind = dict(links.dtypes)["model"]
    return links.groupBy("model").applyInPandas(one, f"model {kind}, label long, root long")


def _settled_by_joins(links: DataFrame, folder: str, rounds: int = 100) -> DataFrame:
    """Labels shrink to the least of their neighbours and of what those shrank to, each round written."""
    both = _written(links.union(links.select("model", "b", "a")), folder, "links")
    now = _written(both.select("model", F.col("a").alias("label")).distinct().withColumn("root", F.col("label")), folder, "round-0")
    total = None
    for n in range(1, rounds):
        near = both.join(now.select("model", F.col("label").alias("b"), "root").hint("merge"), ["model", "b"]).groupBy("model", F.col("a").alias("label")).agg(F.min("root").alias("near"))
        less = now.join(near.hint("merge"), ["model", "label"]).select("model", "label", F.least("root", "near").alias("root"))
        up = now.select("model", F.col("label").alias("root"), F.col("root").alias("up"))
        now = _written(less.join(up.hint("merge"), ["model", "root"], "left").select("model", "label", F.least("root", F.coalesce("up", "root")).alias("root")), folder, f"round-{n}")
        last, total = total, now.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if last == total:
            return now
    raise RuntimeError("bodies did not settle")


def label_bodies_blocks(mask: DataFrame, connectivity: int = 26, block: tuple[int, int, int] = BLOCK, most_edges: int = MOST_EDGES) -> DataFrame:
    """(model, flat, body): the bodies of geometry.label_bodies, numbered alike, with a block of cells a task at most.

    Blocks are labelled in tasks; cells at their borders are joined, which gives
    links between labels; these are settled, in a task a model if it has few,
    and roots are numbered in the order of their first cells. Joins sort: the
    files are far smaller than their rows, so by their size tables that no
    driver holds would be broadcast.
    """
    if connectivity not in OFFSETS:
        raise ValueError(f"connectivity {connectivity} is neither 6 nor 26")
    folder = sinks.scratch(mask.sparkSession, "bodies")
    cells = _written(block_labels(mask, connectivity, block), folder, "blocks")
    links = _written(border_links(cells, connectivity, block), folder, "borders")
    most = links.groupBy("model").count().agg(F.max("count")).first()[0] or 0
    roots = _settled_in_tasks(links) if most <= most_edges else _settled_by_joins(links, folder)
    cells = cells.join(roots.withColumnRenamed("model", "_m").withColumnRenamed("label", "_l").hint("merge"), (F.col("model") == F.col("_m")) & (F.col("label") == F.col("_l")), "left")
    cells = _written(cells.select("model", "flat", F.coalesce("root", "label").alias("root")), folder, "cells")
    numbered = cells.select("model", "root").distinct().withColumn("body", F.row_number().over(Window.partitionBy("model").orderBy("root")).cast("long"))
    return cells.join(numbered.hint("merge"), ["model", "root"]).select("model", "flat", "body")
