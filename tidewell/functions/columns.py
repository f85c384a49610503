"""Column expressions with the guards that ANSI mode and missing values ask for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a, b, at_zero: float | None = None) -> Column:
    """a / b; at_zero (null if not given) where b is 0 or null."""
    b = col(b)
    return F.when(b != 0, col(a) / b).otherwise(F.lit(at_zero).cast("double"))


def pearson(x, y) -> Column:
    """Aggregate: sample correlation of the rows where both are present; null where either is constant."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def half_even(c, digits: int = 0) -> Column:
    return F.bround(col(c), digits)


def portable_uniform(seed: int, *keys) -> Column:
    """In [0, 1) from an md5 of seed and keys: any engine draws the same."""
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), *(col(k).cast("string") for k in keys)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def portable_order(seed: int, *keys) -> Column:
    """A random order that any engine shares."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *(col(k).cast("string") for k in keys)))


def status(old, new, direction) -> Column:
    """BETTER, WORSE or NEUTRAL: NEUTRAL for direction ~, missing values and changes under a thousandth."""
    old, new, direction = col(old), col(new), col(direction)
    change = new - old
    small = F.abs(change) < F.greatest(F.lit(1e-9), F.lit(1e-3) * F.greatest(F.abs(old), F.abs(new)))
    unknown = (direction == "~") | old.isNull() | new.isNull() | F.isnan(old) | F.isnan(new)
    good = ((direction == ">") & (change > 0)) | ((direction == "<") & (change < 0))
    return F.when(unknown | small, "NEUTRAL").when(good, "BETTER").otherwise("WORSE")


def verdict(median) -> Column:
    """PASS under 1, WARN under 2, else FAIL."""
    m = col(median)
    return F.when(m < 1, "PASS").when(m < 2, "WARN").otherwise("FAIL")


def width_text(r) -> Column:
    r = col(r)
    return F.when(r.isNull() | F.isnan(r), "—").when(r > 1, "broadens").otherwise("tightens")


def sheet_key(name, pattern: str) -> tuple[Column, Column]:
    """(cluster, seed) of a sheet name by a pattern with two groups; nulls if it doesn't match."""
    name = col(name)
    fits = name.rlike(pattern)
    return F.when(fits, F.regexp_extract(name, pattern, 1).cast("long")), F.when(fits, F.regexp_extract(name, pattern, 2).cast("long"))


def taper(r, threshold, width) -> Column:
    """0 below threshold - width, 1 from threshold + width, half a cosine between; with width 0 a step at the threshold."""
    r, lo, hi = F.abs(col(r)), col(threshold) - col(width), col(threshold) + col(width)
    inside = F.lit(0.5) * (1 - F.cos(F.lit(3.141592653589793) * F.try_divide(r - lo, hi - lo)))
    return F.when(r >= hi, 1.0).when(r <= lo, 0.0).otherwise(inside)
