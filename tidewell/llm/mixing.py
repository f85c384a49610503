"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import shielded

#: Relative target weights of sources; any other source has 1.
TARGETS = {"src0": 2.0, "src1": 1.5, "src2": 0.5}


#: Rate up to which one Poisson distribution is summed. Its steps would vanish at large rates, so a larger rate is drawn in pieces of PIECE.
MAX_RATE, PIECE = 50.0, 25.0


def rates(docs: DataFrame, targets: dict[str, float] = TARGETS, epochs: float = 1.0, max_rate: float = MAX_RATE) -> DataFrame:
    """(mix_source, rate, pieces, cdf): mean repetitions of a document of each source, and the steps of the Poisson distribution of a piece.

    Sizes are characters of whole texts, so the expected size of source s in
    the mix is its weight's share of epochs times the corpus. A source without
    any text has rate 1. A rate over max_rate is the sum of several equal
    pieces, each of which is drawn by itself; any other is one piece.
    """
    weight = F.lit(1.0)
    for s, w in sorted(targets.items()):
        weight = F.when(F.col("mix_source") == s, float(w)).otherwise(weight)
    sizes = docs.groupBy(F.col("source").cast("string").alias("mix_source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("size"))
    sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight")).withColumn("_k", F.lit(1))
    rate = F.when(F.col("size") > 0, F.lit(epochs) * F.col("all_size") * F.col("weight") / F.col("all_weight") / F.col("size")).otherwise(1.0)
    last = int(max_rate + 12 * math.sqrt(max_rate) + 20)
    # p(k) = exp(-part) part^k / k!, summed step by step
    steps = F.expr(f"""aggregate(sequence(1, {last}), struct(exp(-part) AS p, array(exp(-part)) AS cdf),
        (s, k) -> struct(s.p * part / k AS p, array_append(s.cdf, element_at(s.cdf, -1) + s.p * part / k) AS cdf), s -> s.cdf)""")
    rated = sizes.withColumn("_k", F.lit(1)).join(total, "_k").select("mix_source", rate.alias("rate"))
    rated = rated.withColumn("pieces", F.when(F.col("rate") > max_rate, F.ceil(F.col("rate") / PIECE)).otherwise(F.lit(1)).cast("long"))
    return rated.withColumn("part", F.col("rate") / F.col("pieces")).withColumn("cdf", steps).drop("part")


def uniform(seed: int, *cols):
    """In [0, 1), from the first 52 bits of an md5 of the seed and columns: the same in any engine."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in cols)))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _mixed(docs: DataFrame, targets: dict[str, float], epochs: float, seed: int, most_broadcast: int) -> DataFrame:
    table = rates(docs, targets, epochs)
    few = docs.select("source").distinct().limit(most_broadcast + 1).count() <= most_broadcast
    joined = docs.join(F.broadcast(table) if few else table, F.col("source").cast("string").eqNullSafe(F.col("mix_source")), "left")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # the first piece draws by seed and name alone, the others by their number too
    first = F.expr("cast(size(filter(cdf, c -> c <= mix_u)) as long)")
    draws = F.transform(F.sequence(F.lit(1).cast("long"), F.col("pieces") - 1), lambda i: uniform(seed, name, i))
    more = F.aggregate(draws, F.lit(0).cast("long"), lambda n, u: n + F.size(F.filter("cdf", lambda c: c <= u)))
    copies = joined.withColumn("mix_u", uniform(seed, name)).withColumn("mix_copies", first + F.when(F.col("pieces") > 1, more).otherwise(0))
    out = copies.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.expr("sequence(1L, mix_copies)"))).withColumnRenamed("rate", "mix_rate")
    out = out.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"order{seed}"), name, F.col("mix_copy").cast("string"))))
    return out.drop("mix_source", "pieces", "cdf", "mix_u").repartition(F.col("mix_key")).sortWithinPartitions("mix_key")


ADDED = ["mix_copy", "mix_copies", "mix_rate", "mix_key"]


def mix(docs: DataFrame, targets: dict[str, float] = TARGETS, epochs: float = 1.0, seed: int = 7, most_broadcast: int = 20_000) -> DataFrame:
    """Each document (doc_id, text, source, any other columns) as often as its draw says, in a global random order.

    Adds mix_copy (from 1), mix_copies, mix_rate and mix_key, which orders the
    mix; input columns of these names are replaced. The draw depends on the
    seed and doc_id alone, so a repeated task and repeated rows draw alike.
    Null sources form a source of their own, a null doc_id draws like an empty
    one, and an empty table gives an empty mix. The table of rates is broadcast
    only if it has at most most_broadcast rows.
    """
    inner, _ = shielded(docs.drop(*ADDED), ["doc_id", "text", "source"])
    names = dict(zip(inner.columns, docs.drop(*ADDED).columns, strict=True))
    return _mixed(inner, targets, epochs, seed, most_broadcast).select(*(F.col(n).alias(c) for n, c in names.items()), *ADDED)


def resample(docs: DataFrame, targets: dict[str, float] = TARGETS, epochs: float = 1.0, seed: int = 7, most_broadcast: int = 20_000) -> DataFrame:
    """mix() with the columns of docs alone."""
    inner, restore = shielded(docs, ["doc_id", "text", "source"])
    return restore(_mixed(inner, targets, epochs, seed, most_broadcast))


def mix_sql(targets: dict[str, float] = TARGETS, epochs: float = 1.0, seed: int = 7, max_rate: float = MAX_RATE) -> str:
    """DuckDB SQL of mix() without the texts."""
    weight = " ".join(f"WHEN source = '{s}' THEN {float(w)}" for s, w in sorted(targets.items()))
    last = int(max_rate + 12 * math.sqrt(max_rate) + 20)
    return f"""
WITH sizes AS (SELECT source, sum(coalesce(length(text), 0)) AS size, CASE {weight} ELSE 1.0 END::DOUBLE AS weight FROM documents GROUP BY source),
rated AS (SELECT source, CASE WHEN size > 0 THEN {epochs}::DOUBLE * (SELECT sum(size) FROM sizes)::DOUBLE * weight / (SELECT sum(weight) FROM sizes) / size::DOUBLE ELSE 1.0 END AS rate FROM sizes),
cut AS (SELECT *, CASE WHEN rate > {max_rate}::DOUBLE THEN ceil(rate / {PIECE}::DOUBLE) ELSE 1 END::BIGINT AS pieces FROM rated),
steps AS (SELECT source, k, sum(exp(-rate / pieces + k * ln(rate / pieces) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM cut, range(0, {last + 1}) r(k)),
cdf AS (SELECT source, list(c) AS cdf FROM steps GROUP BY source),
rows AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(doc_id::VARCHAR, '') AS name FROM documents),
drawn AS (SELECT rid, c.cdf, ('0x' || substr(md5('{seed}:' || name || CASE WHEN i = 0 THEN '' ELSE ':' || i END), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)} AS u
    FROM (SELECT d.rid, d.name, d.source, unnest(range(0, r.pieces)) AS i FROM rows d JOIN cut r ON d.source IS NOT DISTINCT FROM r.source) x JOIN cdf c ON x.source IS NOT DISTINCT FROM c.source),
counted AS (SELECT rid, sum(len(list_filter(cdf, lambda x: x <= u)))::BIGINT AS n FROM drawn GROUP BY rid)
SELECT doc_id, source, k AS mix_copy, n AS mix_copies, round(rate, 6) AS mix_rate, md5('order{seed}:' || name || ':' || k::VARCHAR) AS mix_key
FROM (SELECT d.doc_id, d.source, d.name, r.rate, c.n, unnest(range(1, c.n + 1)) AS k FROM rows d JOIN counted c USING (rid) JOIN cut r ON d.source IS NOT DISTINCT FROM r.source WHERE c.n > 0)
"""
