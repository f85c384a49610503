"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialize

_PAIR = "a long, b long"


class Forest:
    """Union-find whose root is the smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (n := up.setdefault(r, r)) != r:
            r = n
        while (n := up[x]) != r:
            up[x], x = r, n
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


#: Edges that one task may hold in a forest (some 100 MB).
MOST_EDGES = 400_000


def _local_stars(edges: DataFrame, most: int | None = None) -> DataFrame:
    """Fewer edges with the same components: each task turns its edges into stars, at most `most` nodes at a time."""

    def run(batches):
        forest = Forest()

        def stars():
            rows = [(x, r) for x in forest.up if (r := forest.root(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], []))], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                forest.join(a, b)
            if most and len(forest.up) >= most:
                yield stars()
                forest = Forest()
        yield stars()

    return edges.mapInArrow(run, _PAIR)


def connected_components(edges: DataFrame, most_edges: int = MOST_EDGES, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node that can be reached.

    Edges are first turned into stars, most_edges of them a task; up to that
    number one task sees all, and its stars are the components. Beyond it,
    large-star and small-star steps of grouped minima and joins alternate until
    all edges are stars; each step is written, so a lost executor costs one
    step. Null ends and loops are ignored.
    """
    given = materialize(
        edges.where("a is not null and b is not null and a <> b").select(
            F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")
        ),
        "edges"
    )
    parts = max(1, -(-given.count() // most_edges))
    if parts == 1:
        now = materialize(_local_stars(given.coalesce(1)), "stars")
    else:
        now = _settle(materialize(_local_stars(given.coalesce(parts), 2 * most_edges).distinct(), "stars"), rounds)
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _settle(now: DataFrame, rounds: int) -> DataFrame:
    state = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are written before they are joined: then both sides come from shuffles, and a node with very many edges can be split
        least = materialize(both.groupBy(F.col("a").alias("u")).agg(F.least(F.col("u"), F.min("b")).alias("m")), "minima")
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # every edge of large goes from a node to a smaller one
        large = materialize(large.where("a <> b").distinct(), "edges")
        least = materialize(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "minima")
        small = large.join(least, F.col("a") == F.col("u")).select(
            F.explode(
                F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
            ).alias("e")
        ).select("e.a", "e.b")
        now = materialize(small.where("a <> b").distinct(), "edges")
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h")).first()
        if state == (row.n, row.h):
            return now
        state = (row.n, row.h)
    raise RuntimeError("components did not settle")


def sorted_intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
