"""Cubes of large deck files, read in byte ranges: no task holds a file.

Spark's text reader cuts files at line borders. A task knows neither where its
range lies in a cube nor whether it lies in one at all, so of each range it keeps
the numbers up to the first slash (they go on with what an earlier range began)
and those after each keyword, as runs of equal values. Sums of the runs' lengths
over the ranges before then give each value its place in the cube.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.sources import sinks
from tidewell.sources.decks import DeckError

#: Name of the section that goes on with what an earlier range began.
GOES_ON = ""
#: Runs of a section that one row holds, and values that one batch gives.
_RUNS, _VALUES = 20_000, 100_000
RUNS = "path string, start long, section string, at long, counts array<long>, values array<double>, n long, ended boolean, bad string"


class _Section:
    """Runs of a section of a range, up to its slash or a token that is no number."""

    def __init__(self, name: str):
        self.name, self.counts, self.values, self.at, self.n, self.ended, self.bad = name, [], [], 0, 0, False, None

    def add(self, token: str) -> None:
        if token == "/":
            self.ended = True
            return
        n, star, v = token.partition("*")
        try:
            value, count = float(v if star else token), int(n) if star else 1
            if count < 0:
                raise ValueError
        except ValueError:
            self.bad = token
            return
        self.values.append(value)
        self.counts.append(count)
        self.n += count

    def take(self) -> tuple:
        """What was added since the last time."""
        out = self.name, self.at, self.counts, self.values, self.n, self.ended, self.bad
        self.at, self.counts, self.values, self.n = self.at + self.n, [], [], 0
        return out


def runs(lines: DataFrame, keywords: list[str]) -> DataFrame:
    """RUNS of lines (path, start, value), in the order in which the reader gives them; start is where the line's range begins in its file.

    at is the place of the row's first value within its section of the range.
    """
    wanted = {k.upper() for k in keywords}

    def run(batches):
        key, open_, met, held = None, [], set(), []

        def taken(sections):
            held.extend((*key, *s.take()) for s in sections)

        def table():
            out = pa.RecordBatch.from_pylist([dict(zip((c.split()[0] for c in RUNS.split(", ")), r, strict=True)) for r in held], schema)
            held.clear()
            return out

        schema = pa.schema([
            ("path", pa.string()), ("start", pa.int64()), ("section", pa.string()), ("at", pa.int64()), ("counts", pa.list_(pa.int64())),
            ("values", pa.list_(pa.float64())), ("n", pa.int64()), ("ended", pa.bool_()), ("bad", pa.string())
        ])
        for b in batches:
            for path, start, line in zip(*(b.column(c).to_pylist() for c in ("path", "start", "value")), strict=True):
                if (path, start) != key:
                    taken(open_)
                    key, open_, met = (path, start), [_Section(GOES_ON)], set()
                for part in line.splitlines():
                    part = part.split("--", 1)[0].strip()
                    name = part.upper()
                    if not part or name in ("ECHO", "NOECHO"):
                        continue
                    if open_:
                        for token in part.replace("/", " / ").split():
                            for s in open_:
                                s.add(token)
                            closed = [s for s in open_ if s.ended or s.bad is not None]
                            if closed:
                                taken(closed)
                                open_ = [s for s in open_ if s not in closed]
                            if not open_:
                                break
                    # only the first block of a keyword counts, so only the first in a range can
                    if name in wanted and name not in met:
                        met.add(name)
                        open_.append(_Section(name))
                full = [s for s in open_ if len(s.counts) >= _RUNS]
                taken(full)
            if held:
                yield table()
        if key:
            taken(open_)
        if held:
            yield table()

    return lines.select("path", "start", "value").mapInArrow(run, RUNS)


def read_runs(spark: SparkSession, path: str | list[str], keywords: list[str], split_bytes: int | None = None) -> DataFrame:
    """RUNS of files, written once. split_bytes is the size of a range (Spark's setting if not given); the setting is put back."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if split_bytes else ()
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "1" if n.endswith("Num") else str(split_bytes))
        lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
        return spark.read.schema(RUNS).parquet(sinks.write_table(runs(lines, keywords), f"{sinks.scratch(spark, 'deck-runs')}/runs"))
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def chains(found: DataFrame, keywords: list[str]) -> DataFrame:
    """(path, keyword, start, section, base, n, ended, bad): the sections that make up the first block of each keyword, and how many values come before each."""
    parts = found.groupBy("path", "start", "section").agg(F.sum("n").alias("n"), F.bool_or("ended").alias("ended"), F.max("bad").alias("bad"))
    first = parts.where(F.col("section") != GOES_ON).groupBy("path", F.col("section").alias("keyword")).agg(F.min("start").alias("first"))
    first = first.where(F.col("keyword").isin([k.upper() for k in keywords])).select(F.col("path").alias("_p"), "keyword", "first")
    in_chain = ((F.col("start") == F.col("first")) & (F.col("section") == F.col("keyword"))) | ((F.col("start") > F.col("first")) & (F.col("section") == GOES_ON))
    rows = parts.join(first, F.col("path") == F.col("_p")).where(in_chain)
    before = Window.partitionBy("path", "keyword").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    over = F.coalesce(F.bool_or(F.col("ended") | F.col("bad").isNotNull()).over(before), F.lit(False))
    rows = rows.withColumn("over", over).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return rows.where("not over").select("path", "keyword", "start", "section", "base", "n", "ended", "bad")


def verdicts(chained: DataFrame, files: DataFrame, keywords: list[str], n_cells: int | None = None) -> DataFrame:
    """(path, keyword, n, problem) of each file (path) and keyword; problem is null where the block is whole."""
    want = files.select("path").distinct().withColumn("keyword", F.explode(F.array(*(F.lit(k.upper()) for k in keywords))))
    sums = chained.groupBy("path", "keyword").agg(F.sum("n").alias("n"), F.bool_or("ended").alias("ended"), F.max("bad").alias("bad"))
    count = F.lit(False) if n_cells is None else F.col("n") != n_cells
    problem = F.when(F.col("n").isNull(), F.concat("keyword", F.lit(" is missing"))).when(
        F.col("bad").isNotNull(), F.concat(F.lit("bad token "), "bad")
    ).when(~F.col("ended"), "the block has no end").when(count, F.format_string("%s has %d values, not %d", "keyword", "n", F.lit(n_cells or 0)))
    return want.join(sums, ["path", "keyword"], "left").select("path", "keyword", "n", problem.alias("problem"))


def values(found: DataFrame, chained: DataFrame) -> DataFrame:
    """(path, keyword, flat, value): the values of the chained sections."""
    at = chained.select(F.col("path").alias("_p"), F.col("start").alias("_s"), F.col("section").alias("_c"), "keyword", "base")
    rows = found.join(at, (F.col("path") == F.col("_p")) & (F.col("start") == F.col("_s")) & (F.col("section") == F.col("_c")))

    def run(batches):
        for b in batches:
            for path, keyword, base, counts, held in zip(
                b.column("path").to_pylist(), b.column("keyword").to_pylist(), b.column("base").to_pylist(), b.column("counts"), b.column("values"), strict=True
            ):
                n, v = np.array(counts.as_py(), np.int64), np.array(held.as_py())
                ends = np.cumsum(n)
                # a run of many equal values is given in pieces, too
                for lo in range(0, int(ends[-1]) if len(ends) else 0, _VALUES):
                    hi = min(lo + _VALUES, int(ends[-1]))
                    i = np.searchsorted(ends, np.arange(lo, hi), side="right")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * (hi - lo)), pa.array([keyword] * (hi - lo)), pa.array(np.arange(base + lo, base + hi)), pa.array(v[i])],
                        names=["path", "keyword", "flat", "value"]
                    )

    return rows.select("path", "keyword", (F.col("base") + F.col("at")).alias("base"), "counts", "values").mapInArrow(run, "path string, keyword string, flat long, value double")


def cubes(spark: SparkSession, path: str | list[str], keywords: list[str], n_cells: int | None = None, split_bytes: int | None = None, strict: bool = True) -> DataFrame:
    """(path, keyword, flat, value) of the keywords' cubes in all files at path, i fastest, read in byte ranges.

    Comments, echo switches, n*v runs and slashes count as in decks.read_cube;
    the first block of a keyword counts. A missing keyword, a block without end,
    a bad token or another number of values than n_cells is an error, or, if not
    strict, leaves out that keyword of that file.
    """
    found = read_runs(spark, path, keywords, split_bytes)
    chained = chains(found, keywords)
    checked = verdicts(chained, found, keywords, n_cells)
    bad = checked.where("problem is not null")
    if strict:
        for r in bad.orderBy("path", "keyword").limit(1).collect():
            raise DeckError(f"{r.path}: {r.problem}")
    else:
        chained = chained.join(checked.where("problem is null").select("path", "keyword"), ["path", "keyword"], "left_semi")
    return values(found, chained)
