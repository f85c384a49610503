"""Exact quantiles of groups of any size, and density curves.

A value's 64 bits, turned so that they sort as the values do, are settled 16 at a
time: a pass counts the values of each group by the next 16 bits, where the bits
before are those already settled for a wanted rank. Four passes leave one value
for each rank. A pass keeps counts alone, so no group's values meet anywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.sources import sinks

#: Bits that one pass settles.
BITS = 16
#: Wanted ranks up to which their table is sent to every executor.
MOST_BROADCAST = 100_000


def _turned(bits: np.ndarray) -> np.ndarray:
    """Bits of doubles as whole numbers that sort as the doubles do; applied again, it gives the bits."""
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def sortable(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, u): the values that are neither null nor NaN, as whole numbers of their order."""
    kinds = dict(rows.dtypes)

    def run(batches):
        for b in batches:
            v = b.column("_v").to_numpy() + 0.0  # no -0.0
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(_turned(v.view(np.int64)))], names=[*keys, "u"])

    held = rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    return held.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "u long"]))


def _same(keys: list[str], prefix: str):
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return out


def exact_quantiles(rows: DataFrame, keys: list[str], wanted=(0.1, 0.5, 0.9), value: str = "value") -> DataFrame:
    """Linear-interpolation quantiles of each group, as p10, p50, ...: those of percentile, with counts instead of values in memory.

    Nulls and NaN are left out, and so are groups of nothing else; null keys are a group of their own.
    """
    spark, folder = rows.sparkSession, sinks.scratch(rows.sparkSession, "quantiles")
    written = lambda df, name: spark.read.schema(df.schema).parquet(sinks.write_table(df, f"{folder}/{name}"))
    data = written(sortable(rows, keys, value), "values")
    sizes = written(data.groupBy(*keys).agg(F.count("*").alias("n")), "sizes")
    at = (F.col("n") - 1) * F.col("q")
    ranks = sizes.withColumn("q", F.explode(F.array(*(F.lit(float(q)) for q in wanted))))
    ranks = ranks.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at))))).select(*keys, "rank").distinct()
    # left is the rank among the values whose settled bits are those of prefix
    now = written(ranks.select(*keys, "rank", F.col("rank").alias("left"), F.lit(0).cast("long").alias("prefix")), "ranks")
    for shift in range(64 - BITS, -1, -BITS):
        bucket, before = F.shiftright("u", shift), F.lit(0).cast("long") if shift == 64 - BITS else F.shiftright("u", shift + BITS)
        open_ = now.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("prefix").alias("_p")).distinct()
        if now.count() <= MOST_BROADCAST:
            open_ = F.broadcast(open_)
        counts = data.join(open_, _same(keys, "_") & (before == F.col("_p"))).groupBy(*keys, F.col("_p"), bucket.alias("bucket")).agg(F.count("*").alias("c"))
        order = Window.partitionBy(*keys, "_p").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = counts.withColumn("upto", F.sum("c").over(order)).select(*(F.col(k).alias(f"_{k}") for k in keys), "_p", "bucket", "c", "upto")
        hit = now.join(sums, _same(keys, "_") & (F.col("prefix") == F.col("_p")) & (F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("c")))
        now = written(hit.select(*keys, "rank", (F.col("left") - F.col("upto") + F.col("c")).alias("left"), F.col("bucket").alias("prefix")), f"pass-{shift}")
    kinds = dict(rows.dtypes)

    def back(batches):
        for b in batches:
            v = _turned(b.column("prefix").to_numpy()).view(np.float64)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), b.column("rank"), pa.array(v)], names=[*keys, "rank", "v"])

    values = now.select(*keys, "rank", "prefix").mapInArrow(back, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "rank long", "v double"]))
    by_rank = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("by_rank"))  # two entries a quantile
    both = by_rank.join(sizes.select(*(F.col(k).alias(f"_{k}") for k in keys), "n"), _same(keys, "_"))
    out = []
    for q in wanted:
        at = (F.col("n") - 1) * F.lit(float(q))
        low, high = F.col("by_rank")[F.floor(at)], F.col("by_rank")[F.ceil(at)]
        out.append(F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(f"p{round(100 * q)}"))
    return both.select(*keys, *out)


def density(rows: DataFrame, keys: list[str], points: int = 64, bins: int = 1024, value: str = "value") -> DataFrame:
    """(keys, x, density): a Gaussian kernel estimate of each group at `points` places from three bandwidths under the least to three over the greatest value.

    The bandwidth is Scott's, n ** -0.2 deviations. A value is shared between the
    two of `bins` places next to it, in proportion to its nearness, and the
    kernel is summed over these: so a group costs its bins, whatever its size.
    Groups of under two values, or without spread, have no curve; nulls and NaN
    are left out.
    """
    v = rows.select(*keys, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    facts = v.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.stddev_samp("v").alias("s")).where("n >= 2 and s > 0")
    facts = facts.withColumn("h", F.col("s") * F.pow(F.col("n"), F.lit(-0.2))).select(*(F.col(k).alias(f"_{k}") for k in keys), "n", "least", "most", "h")
    step = (F.col("most") - F.col("least")) / (bins - 1)
    at = (F.col("v") - F.col("least")) / step
    low = F.least(F.floor(at), F.lit(bins - 2))
    placed = v.join(facts, _same(keys, "_")).select(*keys, low.alias("low"), (at - low).alias("part"))
    shares = placed.groupBy(*keys, "low").agg(F.sum(1 - F.col("part")).alias("a"), F.sum("part").alias("b"))
    weights = shares.select(*keys, F.explode(F.array(F.struct(F.col("low").alias("bin"), F.col("a").alias("w")), F.struct((F.col("low") + 1).alias("bin"), F.col("b").alias("w")))).alias("e"))
    weights = weights.groupBy(*keys, F.col("e.bin").alias("bin")).agg(F.sum("e.w").alias("w")).join(facts, _same(keys, "_"))
    x = F.col("least") - 3 * F.col("h") + (F.col("most") - F.col("least") + 6 * F.col("h")) * F.col("point") / (points - 1)
    near = weights.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", x)
    d = (F.col("x") - F.col("least") - step * F.col("bin")) / F.col("h")
    kernel = F.exp(-d * d / 2) / F.sqrt(2 * F.pi())
    return near.groupBy(*keys, "point").agg(F.max("x").alias("x"), (F.sum(F.col("w") * kernel) / F.max(F.col("n") * F.col("h"))).alias("density")).drop("point")
