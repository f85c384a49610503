"""Queries on decks that are read in byte ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.plans.registry import query
from tidewell.sources import sinks, split_decks

#: Parts of one deck, and bytes of a range: a deck is cut into some tens of ranges.
A_DECK, RANGE = 500, 2048


def _decks(v) -> str:
    """A deck every A_DECK parts, in files of many lines: two cubes with runs, comments and echo switches."""
    p = v.table("part").select(F.floor(F.col("p_partkey") / A_DECK).alias("deck"), F.col("p_partkey").alias("k"), "p_size", "p_retailprice")
    size = F.concat(F.when(F.col("k") % 5 == 0, "3*").otherwise("1*"), F.col("p_size").cast("string"), F.when(F.col("k") % 7 == 0, " -- 9 / of 1*2").otherwise(""))
    price = F.concat(F.format_string("%.2f", "p_retailprice"), F.when(F.col("k") % 11 == 0, "\t0.5").otherwise(""))
    body = [(1, size), (4, price)]
    fixed = [(0, "-- cubes\nECHO\nPoro"), (2, "/\nOTHER\n 1 2 3 /\n"), (3, "PERMX -- second"), (5, "/")]
    lines = None
    for place, text in body:
        part = p.select("deck", F.lit(place).alias("place"), "k", text.alias("value"))
        lines = part if lines is None else lines.unionByName(part)
    heads = p.select("deck").distinct()
    for place, text in fixed:
        lines = lines.unionByName(heads.select("deck", F.lit(place).alias("place"), F.lit(0).cast("long").alias("k"), F.lit(text).alias("value")))
    path = f"{sinks.scratch(v.spark, 'decks')}/decks"
    lines.repartition("deck").sortWithinPartitions("deck", "place", "k").select("deck", "value").write.partitionBy("deck").text(path)
    return path


@query("s08_split_cubes", f"""
p AS (SELECT (p_partkey // {A_DECK})::BIGINT AS deck, p_partkey AS k, p_size, p_retailprice FROM part),
runs AS (SELECT deck, 'PORO' AS keyword, k, 0 AS sub, CASE WHEN k % 5 = 0 THEN 3 ELSE 1 END AS n, p_size::DOUBLE AS value FROM p
UNION ALL SELECT deck, 'PERMX', k, 0, 1, p_retailprice FROM p UNION ALL SELECT deck, 'PERMX', k, 1, 1, 0.5 FROM p WHERE k % 11 = 0),
expanded AS (SELECT deck, keyword, value, row_number() OVER (PARTITION BY deck, keyword ORDER BY k, sub, r) - 1 AS flat FROM runs, LATERAL (SELECT unnest(range(n)) AS r))
SELECT deck, keyword, flat, round(value, 2) AS value FROM expanded""")
def _(v):
    cells = split_decks.cubes(v.spark, _decks(v), ["PORO", "PERMX"], split_bytes=RANGE)
    return cells.select(F.regexp_extract("path", r"deck=(\d+)", 1).cast("long").alias("deck"), "keyword", "flat", F.round("value", 2).alias("value"))
