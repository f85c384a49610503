"""URL filters: rules by host and path, then logistic regression on hashed character n-grams."""

from __future__ import annotations

from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import small_batches

#: (host, path, verdict). A rule fits its host and all subdomains if the path starts with the rule's.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

#: 240 urls made up by hand for this package, beside this file: 90 to be blocked (gambling, pills, adult, loans, piracy, fraud,
#: spam, advertising) and 150 ordinary ones. Fronts, top domains and plain paths alternate alike in both, so only names tell them apart.
LABELLED = "labelled_urls.csv"


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): 1 is to be blocked. Any other small table of this shape may take its place."""
    lines = files(__package__).joinpath(LABELLED).read_text(encoding="utf-8").splitlines()[1:]
    return spark.createDataFrame([(url, int(label)) for url, _, label in (x.rpartition(",") for x in lines)], "url string, label int")


def split_url(url):
    """Columns host (A-Z lower-cased) and path of a url column; both empty without '://'."""
    tail = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(tail, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host, path, rules=RULES):
    """Columns (rule, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def ngrams(host: str, path: str, sizes=(3, 4, 5), buckets: int = 1 << 14) -> np.ndarray:
    """Buckets of the character n-grams of host and path, kept apart by a prefix."""
    import zlib

    out = set()
    for kind, s in (("h", f"^{host}$"), ("p", f"{path}$")):
        for n in sizes:
            out.update(zlib.crc32(f"{kind}{s[i : i + n]}".encode("utf-8", "surrogatepass")) % buckets for i in range(len(s) - n + 1))
    return np.fromiter(sorted(out), np.int64, len(out))


def train(features: list[np.ndarray], labels, buckets: int = 1 << 14, rounds: int = 500, rate: float = 4.0, l2: float = 1e-4) -> np.ndarray:
    """Full-batch gradient descent; the last weight is the bias. Deterministic."""
    w, y = np.zeros(buckets + 1), np.asarray(labels, float)
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    cols = np.concatenate(features) if features else np.empty(0, np.int64)
    scale = np.array([1 / max(1, len(f)) ** 0.5 for f in features])
    for _ in range(rounds if len(y) else 0):
        z = np.bincount(rows, w[cols] * scale[rows], len(y)) + w[-1]
        e = (1 / (1 + np.exp(-z)) - y) / len(y)
        w[:-1] -= rate * (np.bincount(cols, e[rows] * scale[rows], buckets) + l2 * w[:-1])
        w[-1] -= rate * e.sum()
    return w


def score(w: np.ndarray, f: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-(w[f].sum() / max(1, len(f)) ** 0.5 + w[-1]))))


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, threshold: float = 0.5, most: int = 20_000) -> DataFrame:
    """Judge every url of pages (page_id, url).

    Returns page_id, host, path, rule (null if none fits), verdict (the rule's;
    else block if the model's score is at least threshold) and score. A null or
    malformed url has empty host and path and is judged by the model on these.
    The model is fitted on at most `most` labelled rows, a documented bound;
    null urls or labels in that table are skipped. Each row is judged alone:
    repeated rows repeat; other columns are ignored.
    """
    spark = pages.sparkSession
    small_batches(spark)
    host, path = split_url(F.col("url"))
    sample = (
        labelled if labelled is not None else labelled_urls(spark)
    ).where("url is not null and label is not null").select(
        host.alias("host"), path.alias("path"), "label"
    ).orderBy("host", "path", "label").limit(most).collect()
    w = train([ngrams(r.host, r.path) for r in sample], [r.label for r in sample])
    weights = spark.sparkContext.broadcast(w)

    def run(batches):
        w = weights.value
        for b in batches:
            s = [score(w, ngrams(h, p)) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            yield b.append_column("score", pa.array(s, pa.float64()))

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")
    ).mapInArrow(run, "page_id long, host string, path string, score double")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score"
    )
