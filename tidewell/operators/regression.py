"""Least squares from sums of products, with bootstrap intervals and cross-validation.

A task turns the rows it has into sums of products for each group: one for each
fold, and one for each resample, in which a row counts as often as a Poisson draw
says. Such sums are added in a shuffle, whatever the order, so no group meets in
one place; a fold is left out by taking its sums from the total.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Modulus and steps of the draws: x * x + step, three times, in whole numbers that any engine has.
PRIME, STEPS, STRIDE = 2147483629, (40503, 1013904223, 69069), 1000003
#: Cumulative probabilities of the Poisson distribution with mean 1, from 0 on.
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.maximum(np.arange(13), 1)))
#: Bytes of sums that a task holds before it hands them on, and draws of one matrix product.
_HELD, _DRAWS = 64 << 20, 200


def row_hash(seed: int, *keys) -> F.Column:
    """A number below PRIME from an md5 of seed and keys."""
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % PRIME


def draws(h: np.ndarray, first: int, n: int) -> np.ndarray:
    """How often each row counts in the resamples first to first + n - 1: draws by resamples."""
    x = (h[None, :] + STRIDE * (np.arange(first, first + n, dtype=np.int64)[:, None] + 1)) % PRIME
    for step in STEPS:
        x = (x * x + step) % PRIME
    u = x / PRIME
    out = np.zeros(u.shape)
    for p in POISSON:
        out += u >= p
    return out


def _products(v: np.ndarray) -> np.ndarray:
    """For each row: 1, its values, and the products of every two of them."""
    i, j = np.triu_indices(v.shape[1])
    return np.hstack([np.ones((len(v), 1)), v, v[:, i] * v[:, j]])


def sums_of_products(rows: DataFrame, columns: list[str], resamples: int, folds: int) -> DataFrame:
    """(group, part, idx, s0, s1, ...): sums over rows (group, h, columns) without nulls, for part `fold` by h modulo folds and for part `draw` by resample."""
    q = len(columns)
    width = 1 + q + q * (q + 1) // 2

    def run(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def table():
            for group, (fold, draw) in held.items():
                for part, sums in (("fold", fold), ("draw", draw)):
                    if len(sums):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([group] * len(sums), pa.string()), pa.array([part] * len(sums)), pa.array(np.arange(len(sums)), pa.int32()), *map(pa.array, sums.T)],
                            names=["group", "part", "idx", *(f"s{i}" for i in range(width))]
                        )
            held.clear()

        for b in batches:
            groups = b.column("group").to_numpy(zero_copy_only=False)
            h, values = b.column("h").to_numpy(), np.column_stack([b.column(c).to_numpy() for c in columns]) if b.num_rows else np.empty((0, q))
            for group in pd.unique(groups):
                mine = groups == group
                hs, products = h[mine], _products(values[mine])
                fold, draw = held.setdefault(group, (np.zeros((folds, width)), np.zeros((resamples, width))))
                np.add.at(fold, hs % folds, products)
                for at in range(0, resamples, _DRAWS):
                    n = min(_DRAWS, resamples - at)
                    draw[at : at + n] += draws(hs, at, n) @ products
                if sum(f.nbytes + d.nbytes for f, d in held.values()) > _HELD:
                    yield from table()
        yield from table()

    schema = "group string, part string, idx int, " + ", ".join(f"s{i} double" for i in range(width))
    return rows.select("group", "h", *columns).mapInArrow(run, schema).groupBy("group", "part", "idx").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(width)))


def _unpacked(s: np.ndarray, q: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, means, covariances) from sums."""
    n = s[0]
    if n <= 0:
        return 0.0, np.zeros(q), np.zeros((q, q))
    m, c = s[1 : 1 + q] / n, np.zeros((q, q))
    i, j = np.triu_indices(q)
    c[i, j] = c[j, i] = s[1 + q :] / n
    return n, m, c - np.outer(m, m)


def solve(c: np.ndarray, use: list[int]) -> np.ndarray:
    """Coefficients of the last column on the used ones, the shortest where those depend on each other."""
    sd = np.sqrt(np.maximum(np.diag(c), 0.0))
    # what the sums can't tell from a constant is one
    scale = np.where(sd[use] > 1e-9, sd[use], np.inf)
    r = c[np.ix_(use, use)] / scale[:, None] / scale[None]
    return np.linalg.pinv(r, rcond=1e-10, hermitian=True) @ (c[use, -1] / scale) / scale


def r2_of(c: np.ndarray, use: list[int]) -> float:
    """Share of the last column's variance that the used columns explain; not a number if it has none."""
    if c[-1, -1] <= 1e-18:
        return float("nan")
    return float(c[use, -1] @ solve(c, use) / c[-1, -1])


def _held_out(test: np.ndarray, train: np.ndarray, q: int, use: list[int]) -> float:
    """R2 on a fold of the fit to all others."""
    n, m, c = _unpacked(test, q)
    k, mt, ct = _unpacked(train, q)
    if not n or not k or c[-1, -1] <= 1e-18:
        return float("nan")
    b = np.zeros(q)
    b[use] = -solve(ct, use)
    b[-1] = 1.0
    # squared error around the fit: its variance, and the square of its mean
    return float(1 - (b @ c @ b + (b @ (m - mt)) ** 2) / c[-1, -1])


def _scaled(rows: DataFrame, group: str, columns: list[str], key: list[str], seed: int) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """(group, h, columns) of complete rows, less the overall means and over the overall deviations, so that products lose no digits; and these."""
    whole = rows.select(F.col(group).cast("string").alias("group"), row_hash(seed, *key).alias("h"), *(F.col(c).cast("double").alias(c) for c in columns))
    whole = whole.select("group", "h", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns)).dropna(subset=columns)
    r = whole.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("d", F.stddev_pop)))).first()
    scale = {c: (r[f"m{i}"] or 0.0, r[f"d{i}"] or 1.0) for i, c in enumerate(columns)}
    return whole.select("group", "h", *(((F.col(c) - m) / d).alias(c) for c, (m, d) in scale.items())), scale


UPLIFT = "group string, r2_base double, r2_full double, uplift double, ci_low double, ci_high double, n long, r2_base_cv double, r2_full_cv double, uplift_cv double"


def r2_uplift(rows: DataFrame, group: str, base: list[str], extra: list[str], y: str, resamples: int = 2000, seed: int = 42, key: list[str] | None = None, folds: int = 5) -> DataFrame:
    """Gain in R2 from the extra predictors over complete rows of each group, with a bootstrap interval and cross-validated values.

    key names the columns that tell rows apart for the draws (all used ones if
    not given: then equal rows are drawn alike). Groups of under predictors + 5
    rows have no values, those of under 2 folds' rows no cross-validated ones; a
    fold without rows or spread is left out of the mean.
    """
    columns, q = [*base, *extra, y], len(base) + len(extra) + 1
    use = {"base": list(range(len(base))), "full": list(range(q - 1))}
    scaled, _ = _scaled(rows, group, columns, key or [group, *columns], seed)
    sums = sums_of_products(scaled, columns, resamples, folds)
    names = [f"s{i}" for i in range(1 + q + q * (q + 1) // 2)]

    def gains(batches):
        for b in batches:
            s = np.column_stack([b.column(c).to_numpy() for c in names])
            u = []
            for x in s:
                _, _, c = _unpacked(x, q)
                u.append(r2_of(c, use["full"]) - r2_of(c, use["base"]))
            yield pa.RecordBatch.from_arrays([b.column("group"), pa.array(u, pa.float64())], names=["group", "u"])

    def fits(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf[names].to_numpy(float)
        total = s.sum(0)
        n, _, c = _unpacked(total, q)
        out = dict.fromkeys([x.split()[0] for x in UPLIFT.split(", ")], float("nan")) | {"group": pdf["group"].iloc[0], "n": int(round(n))}
        if n >= q + 4:
            cv = {k: float("nan") for k in use}
            if n >= 2 * folds:
                for k, cols in use.items():
                    scores = [x for x in (_held_out(f, total - f, q, cols) for f in s) if x == x]
                    cv[k] = float(np.mean(scores)) if scores else float("nan")
            base_, full = r2_of(c, use["base"]), r2_of(c, use["full"])
            out |= {"r2_base": base_, "r2_full": full, "uplift": full - base_, "r2_base_cv": cv["base"], "r2_full_cv": cv["full"], "uplift_cv": cv["full"] - cv["base"]}
        return pd.DataFrame([out])

    # a group has a row a fold here, and a row a resample below
    fitted = sums.where("part = 'fold'").groupBy("group").applyInPandas(fits, UPLIFT)
    drawn = sums.where("part = 'draw'").mapInArrow(gains, "group string, u double").where(~F.isnan("u")).groupBy(F.col("group").alias("_g")).agg(
        F.percentile("u", F.array(F.lit(0.025), F.lit(0.975))).alias("ci")
    )
    both = fitted.drop("ci_low", "ci_high").join(drawn, F.col("group").eqNullSafe(F.col("_g")), "left")
    has = F.col("r2_base").isNotNull() & ~F.isnan("r2_base")
    both = both.withColumn("ci_low", F.when(has, F.col("ci")[0])).withColumn("ci_high", F.when(has, F.col("ci")[1]))
    return both.select(*(x.split()[0] for x in UPLIFT.split(", ")))


SRC2 = "group string, predictor string, src2 double, stability_fraction double, n long"


def src2(rows: DataFrame, group: str, predictors: list[str], y: str, resamples: int = 2000, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """Squared standardised coefficients of complete rows, and the share of resamples in which each keeps its sign; groups of under 3 rows are left out."""
    columns, q = [*predictors, y], len(predictors) + 1
    use = list(range(q - 1))
    scaled, _ = _scaled(rows, group, columns, key or [group, *columns], seed)
    sums = sums_of_products(scaled, columns, resamples, 1)
    names = [f"s{i}" for i in range(1 + q + q * (q + 1) // 2)]

    def coefficients(batches):
        for b in batches:
            out = []
            for x in np.column_stack([b.column(c).to_numpy() for c in names]):
                n, _, c = _unpacked(x, q)
                deviation = np.sqrt(max(c[-1, -1], 0.0) * n / max(n - 1, 1))
                out.append((n, solve(c, use) * np.sqrt(np.maximum(np.diag(c)[use], 0.0)) / (deviation + 1e-12)))
            yield pa.RecordBatch.from_arrays(
                [b.column("group"), b.column("part"), pa.array([n for n, _ in out], pa.float64()), pa.array([x.tolist() for _, x in out], pa.list_(pa.float64()))],
                names=["group", "part", "n", "b"]
            )

    found = sums.mapInArrow(coefficients, "group string, part string, n double, b array<double>").select(
        "group", "part", "n", F.posexplode("b").alias("place", "b")
    )
    whole = found.where("part = 'fold' and n >= 3").select("group", "place", "n", "b")
    drawn = found.where("part = 'draw'").select(F.col("group").alias("_g"), F.col("place").alias("_p"), (F.col("b") >= 0).alias("up"))
    same = F.avg(F.when(F.col("up") == (F.col("b") >= 0), 1.0).otherwise(0.0))
    both = whole.join(drawn, F.col("group").eqNullSafe(F.col("_g")) & (F.col("place") == F.col("_p")), "left").groupBy("group", "place", "n", "b").agg(same.alias("stability_fraction"))
    name = F.element_at(F.array(*map(F.lit, predictors)), F.col("place") + 1)
    return both.select("group", name.alias("predictor"), (F.col("b") * F.col("b")).alias("src2"), "stability_fraction", F.round("n").cast("long").alias("n"))
