"""Quality rules: fixed base rules, and thresholds drawn from mergeable quantile sketches by language and source.

Sketches and limits are in logarithmic buckets: a limit is a number of interquartile *ratios* over the upper quartile.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import WordHash, covered, materialize, shielded, small_batches, window_hash, words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]

#: Share of a sketch's bucket: a quantile is known to about 2 %.
GAMMA = 1.04
#: metric: (what is judged, what its sketches hold, fences, least spread in buckets).
#: Sketches of shares count one case more than there is: so a group without any has a spread as well, and what
#: one more case would make in its usual texts. The least spreads, a factor of 2 and the sketch's resolution, stand
#: in where a group's quartiles coincide; there is no least or greatest limit.
METRICS = {
    "symbol_share": ("n_symbols / greatest(word_chars, 1)", "(n_symbols + 1) / (word_chars + 1)", 2, 18),
    "dup_line_share": ("n_dup_lines / greatest(n_lines, 1)", "(n_dup_lines + 1) / (n_lines + 1)", 1, 18),
    "long_words": ("word_chars / greatest(n_words, 1)", "word_chars / greatest(n_words, 1)", 8, 1),
    "short_words": ("n_words / greatest(word_chars, 1)", "n_words / greatest(word_chars, 1)", 8, 1),
}


def text_counts(text: str | None, hashes: WordHash) -> tuple[int, ...]:
    """COUNTS of one text."""
    ws = words(text)
    n = len(ws)
    if not n:
        return (0,) * len(COUNTS)
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    repeat = 0
    if n >= 5:
        h = window_hash(hashes.of(ws), 5)
        _, at, times = np.unique(h, return_inverse=True, return_counts=True)
        starts = np.nonzero(times[at] > 1)[0]
        repeat = int(covered(starts, 5, n).sum()) if len(starts) else 0
    return n, len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(lines), repeat


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns of docs and COUNTS of its text, as _-prefixed columns where names clash."""
    small_batches(docs.sparkSession)
    names = [f"q_{c}" for c in COUNTS]
    docs = docs.select(*keep, F.col("text").cast("string").alias("q_text"))

    def run(batches):
        hashes = WordHash()
        for b in batches:
            rows = [text_counts(t.as_py(), hashes) for t in b.column("q_text")]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c, pa.int64()) for c in cols)], names=[*keep, *names])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} long" for c in names)]))


def _metric(name: str, sketched: bool = False):
    e = METRICS[name][sketched]
    for c in sorted(COUNTS, key=len, reverse=True):
        e = e.replace(c, f"q_{c}")
    return F.expr(e)


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): one logarithmic sketch a group and metric; merging is adding n."""
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), _metric(m, True).alias("v")) for m in METRICS)))
    return (
        counted.where("q_n_words > 0").select("lang", "source", values.alias("x"))
        .select("lang", "source", "x.metric", F.ceil(F.log(F.col("x.v")) / math.log(GAMMA)).cast("long").alias("bucket"))
        .groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))
    )


def quantiles(sketch: DataFrame, keys: list[str], at: list[float]) -> DataFrame:
    """(keys, metric, total, q0, q1, ...) of merged sketches; quantiles are buckets."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "metric")
    seen = merged.withColumn("cum", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    return seen.groupBy(*keys, "metric").agg(
        F.first("total").alias("total"),
        *(F.min(F.when(F.col("cum") >= F.lit(q) * F.col("total"), F.col("bucket"))).alias(f"q{i}") for i, q in enumerate(at))
    )


def thresholds(sketch: DataFrame, least_group: int = 50, fences: float = 1.0) -> DataFrame:
    """(lang, source, one limit a metric): the upper quartile and as many interquartile ranges above it, in buckets, as
    the metric has fences (times `fences`).

    Junk in over a quarter of a group is its upper quartile and would loosen
    that limit beyond any value. So the limit is at most the median plus twice
    as many distances from the lower quartile to the median, which holds up to
    a half of junk.
    A group under least_group documents takes its language's limits, a language
    under that the corpus's: their sketches are merged, not counted anew.
    """
    at = [0.25, 0.5, 0.75]

    def limit(m):
        times, least = fences * METRICS[m][2], METRICS[m][3]
        upper = F.col("q2") + F.lit(times) * F.greatest(F.lit(least), F.col("q2") - F.col("q0"))
        middle = F.col("q1") + F.lit(2 * times) * F.greatest(F.lit(least), F.col("q1") - F.col("q0"))
        return F.pow(F.lit(GAMMA), F.least(upper, middle))

    def wide(keys, tag):
        q = quantiles(sketch, keys, at)
        return q.groupBy(*keys).agg(F.max("total").alias(f"n_{tag}"), *(F.max(F.when(F.col("metric") == m, limit(m))).alias(f"{tag}_{m}") for m in METRICS))

    own, lang, all_ = wide(["lang", "source"], "own"), wide(["lang"], "lang").withColumnRenamed("lang", "l_lang"), wide([], "all")
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left").withColumn("_k", F.lit(1)).join(all_.withColumn("_k", F.lit(1)), "_k", "left")

    def pick(m):
        return F.when(F.col("n_own") >= least_group, F.col(f"own_{m}")).when(F.col("n_lang") >= least_group, F.col(f"lang_{m}")).otherwise(F.col(f"all_{m}"))

    return joined.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *(pick(m).alias(f"limit_{m}") for m in METRICS))


def judge(counted: DataFrame, limits: DataFrame, most_broadcast: int = 100_000) -> DataFrame:
    """Add base_failed and kept. The limits are broadcast only if they are at most most_broadcast rows."""
    limits = materialize(limits, "quality-limits")
    few = limits.count() <= most_broadcast
    base = (F.col("q_n_words") < 10) | (100 * F.col("q_n_repeat_words") > 20 * F.col("q_n_words"))
    fine = reduce(lambda a, b: a & b, (~F.coalesce(_metric(m) > F.col(f"limit_{m}"), F.lit(False)) for m in METRICS))
    joined = counted.join(
        F.broadcast(limits) if few else limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")),
        "left"
    )
    return joined.withColumn("base_failed", base).withColumn("kept", ~base & fine).drop("t_lang", "t_source")


def score_quality(docs: DataFrame, least_group: int = 50, fences: float = 1.0) -> DataFrame:
    """Judge every whole text of docs (doc_id, text, lang, source).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept and the limits that held. A null or empty
    text has no words and fails; null languages and sources form groups of
    their own; repeated rows are judged alike; other columns are ignored.
    """
    counted = materialize(
        with_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source"), ["doc_id", "lang", "source"]),
        "quality-counts"
    )
    out = judge(counted, thresholds(sketches(counted), least_group, fences))
    return out.select("doc_id", *(F.col(f"q_{c}").alias(c) for c in COUNTS if c != "n_lines"), "base_failed", "kept", *(f"limit_{m}" for m in METRICS))


def keep_good(docs: DataFrame, least_group: int = 50, fences: float = 1.0) -> DataFrame:
    """The rows of docs, with all their columns, that score_quality keeps. Texts are read twice and never shuffled."""
    inner, restore = shielded(docs, ["text", "lang", "source"])
    limits = thresholds(sketches(with_counts(inner, ["lang", "source"])), least_group, fences)
    return restore(judge(with_counts(inner, inner.columns), limits).where("kept"))
