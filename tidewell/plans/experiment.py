"""From a folder of decks to tables: cells, wells, descriptors and connectivity of each deck.

A deck is a folder with a *.data file and an INCLUDE folder of files named after
it: _GRID.inc and .grdecl (the grid, which all decks of an experiment share),
_PORO, _PERMX, _NTG, _WELLTRACK and _SCHEDULE.inc. A deck's cubes are parsed by
one task; everything after that is joins and aggregations of cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import geology, geometry, production
from tidewell.schemas import nan_to_null
from tidewell.sources import decks, sinks, tables

#: Endings of the files of a deck.
ENDINGS = {
    "_GRID.inc": "grid", ".grdecl": "corners", "_PORO.inc": "poro", "_PERMX.inc": "permx", "_NTG.inc": "ntg", "_SATNUM.inc": "satnum",
    "_WELLTRACK.inc": "tracks", "_SCHEDULE.inc": "schedule"
}
FILES = "model long, directory string, text string, kind string"
CELLS = "model long, flat long, i int, j int, k int, poro double, permx double, ntg double"
#: Folder names are short and one a deck; up to so many go to every executor.
MOST_DECKS = 100_000


def _files(spark: SparkSession, pattern: str, content: bool) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    if found is None or not len(found):
        return spark.createDataFrame([], "path string" + ", text string" * content)
    df = spark.read.format("binaryFile").load(pattern)
    return df.select("path", F.decode("content", "UTF-8").alias("text")) if content else df.select("path")


def _folders(spark: SparkSession, pattern: str) -> DataFrame:
    """(directory): the parents of what matches, by the file system's listing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    return spark.createDataFrame([(x.getPath().getParent().toString(),) for x in found], "directory string")


def scan(spark: SparkSession, root: str, experiment: int) -> DataFrame:
    """(model, experiment, directory, deck_name, stem, cluster, seed, centroid): one row a deck below root; model numbers them by folder."""
    found = decks.scan_decks(_files(spark, f"{root}/*/*.data", False))
    name = F.element_at(F.split("path", "/"), -1)
    model = F.row_number().over(Window.orderBy("directory")).cast("long")
    return found.select(
        model.alias("model"), F.lit(experiment).cast("long").alias("experiment"), "directory", name.alias("deck_name"),
        F.expr("substring(path, length(directory) + 2, length(path) - length(directory) - 6)").alias("stem"), "cluster", "seed", "centroid"
    )


@dataclass
class Experiment:
    """Tables of the decks below root; cells are parsed once, into the folder `work`."""

    spark: SparkSession
    root: str
    number: int
    work: str | None = None
    cutoff: float | None = None

    def __post_init__(self):
        self.work = self.work or sinks.scratch(self.spark, f"experiment{self.number}")
        self.decks = tables.cached(self.spark, f"{self.work}/decks", lambda: scan(self.spark, self.root, self.number))
        if self.decks.limit(MOST_DECKS + 1).count() > MOST_DECKS:
            raise ValueError(f"over {MOST_DECKS} decks below {self.root}")
        # each kind in a folder of its own, so that a reader of one kind reads no other's texts
        path = f"{self.work}/files"
        if not tables.exists(self.spark, path):
            self._named().write.partitionBy("kind").parquet(path)
        self.files = self.spark.read.schema(FILES).parquet(path)
        first = self.files.where("kind in ('grid', 'corners')").groupBy("model").agg(F.count("*").alias("n")).where("n = 2").agg(F.min("model")).first()[0]
        self.grid = None
        if first is not None:
            text = self.files.where((F.col("model") == first) & (F.col("kind") == "grid")).first().text
            self.grid = {k: v for k, v in decks.read_grid(text).items() if k in ("nx", "ny", "nz", "faults")}
            self._corners = self.files.where((F.col("model") == first) & (F.col("kind") == "corners")).select(F.lit("grid").alias("path"), "text")

    def _named(self) -> DataFrame:
        """The files of all decks (model, directory, kind, text), by their names' endings."""
        parts = F.split("path", "/")
        files = _files(self.spark, f"{self.root}/*/INCLUDE/*", True).withColumn(
            "_d", F.array_join(F.slice(parts, 1, F.size(parts) - 2), "/")
        ).withColumn("_n", F.element_at(parts, -1))
        ending = F.expr("substring(_n, length(stem) + 1)")
        kind = F.lit(None).cast("string")
        for e, k in ENDINGS.items():
            kind = F.when(ending == e, k).otherwise(kind)
        return files.join(
            F.broadcast(self.decks.select("model", "directory", "stem")), (F.col("_d") == F.col("directory")) & F.col("_n").startswith(F.col("stem"))
        ).withColumn("kind", kind).where("kind is not null").select("model", "directory", "kind", "text")

    def _of(self, kind: str) -> DataFrame:
        return self.files.where(F.col("kind") == kind).select(F.col("model").cast("string").alias("path"), "text")

    def pillars(self) -> DataFrame:
        p, at = F.floor(F.col("pos") / 6), F.col("pos") % 6
        n = self.grid["nx"] + 1
        g = decks.corners(self._corners, "COORD").where(at < 2).groupBy((p % n).cast("int").alias("i"), F.floor(p / n).cast("int").alias("j"))
        return g.agg(F.max(F.when(at == 0, F.col("value"))).alias("x"), F.max(F.when(at == 1, F.col("value"))).alias("y"))

    def layers(self) -> DataFrame:
        return geometry.layers_from_zcorn(decks.corners(self._corners, "ZCORN").select("pos", F.col("value").alias("z")), self.grid["nx"], self.grid["ny"])

    def _parse_cells(self) -> DataFrame:
        nx, ny, n = self.grid["nx"], self.grid["ny"], self.grid["nx"] * self.grid["ny"] * self.grid["nz"]
        wide = self.files.groupBy("model").pivot("kind", ["poro", "permx", "ntg"]).agg(F.first("text"))

        def run(batches):
            for b in batches:
                for model, *texts in zip(b["model"], b["poro"], b["permx"], b["ntg"], strict=True):
                    found = {}
                    for text, name in zip(texts, ("poro", "permx", "ntg"), strict=True):
                        try:
                            found[name] = decks.read_cube(text, name.upper(), n) if isinstance(text, str) else None
                        except decks.DeckError:
                            found[name] = None  # as a deck without this file
                    if all(x is None for x in found.values()):
                        continue
                    flat = pd.RangeIndex(n).to_numpy()
                    yield pd.DataFrame(
                        {
                            "model": model, "flat": flat, "i": flat % nx, "j": flat // nx % ny, "k": flat // (nx * ny),
                            **{c: np.nan if x is None else x for c, x in found.items()}
                        }
                    )

        return wide.mapInPandas(run, CELLS)

    def all_cells(self) -> DataFrame:
        """Cells of all decks that have a whole cube, with nulls for the cubes that are absent or broken."""
        return tables.cached(self.spark, f"{self.work}/cells", lambda: nan_to_null(self._parse_cells()))

    def cells(self) -> DataFrame:
        """Cells of all decks whose three cubes are whole, with the deck's cutoff."""
        cells = self.all_cells().where("poro is not null and permx is not null and ntg is not null")
        if self.cutoff is not None:
            return cells.withColumn("cutoff", F.lit(float(self.cutoff)))
        cut = tables.cached(self.spark, f"{self.work}/cutoffs", lambda: geometry.perm_cutoff(cells, ["model"]))
        return cells.join(cut, "model")

    def traversals(self, step: float = 1.0) -> DataFrame:
        """Cells along the wells of all decks."""

        def build():
            quads = tables.cached(self.spark, f"{self.work}/quads", lambda: geometry.grid_quads(self.pillars()).drop("cx", "cy"))
            xs, ys = [F.col(f"x{n}") for n in range(4)], [F.col(f"y{n}") for n in range(4)]
            size = quads.agg(F.max(F.greatest(F.greatest(*xs) - F.least(*xs), F.greatest(*ys) - F.least(*ys)))).first()[0]
            of = lambda df: df.withColumn("model", F.col("path").cast("long")).drop("path")
            tracks, perfs = of(decks.tracks(self._of("tracks"))), of(decks.perforations(self._of("schedule")))
            return geometry.traverse(tracks, quads, self.layers(), perfs, step, size or 1.0)

        return tables.cached(self.spark, f"{self.work}/traversals", build)

    def descriptors(self, step: float = 1.0) -> DataFrame:
        """A row a deck and well: cells traversed, perforated and of sand, net sand, flow capacity, share of sand, mean net-to-gross."""
        c = self.cells()
        cut = c.select("model", F.col("cutoff").alias("perm_cutoff_mD")).distinct()
        out = geology.well_descriptors(self.traversals(step), c, F.col("cutoff")).join(cut, "model")
        return self.decks.select("model", "experiment", "directory", "deck_name", "cluster", "seed").join(out, "model").drop("model")

    def connectivity(self, step: float = 1.0) -> DataFrame:
        """A row a deck: its bodies at both connectivities, the largest one, and how producers meet injectors through bodies."""
        mask = self.cells().where(geology.sand(F.col("cutoff"))).drop("cutoff")
        out = geometry.deck_connectivity(mask, self.traversals(step).select("model", "well", "i", "j", "k").distinct())
        return self.decks.select("model", "experiment", "directory", "cluster", "seed").join(out, "model").drop("model")

    def index(self) -> DataFrame:
        """A row a deck: which files it has, whether it has results, and its number of wells."""
        wells = decks.tracks(self._of("tracks")).select(F.col("path").cast("long").alias("model"), "well").join(
            F.broadcast(self.decks.select("model", "directory")), "model"
        ).select("directory", "well")
        results = _folders(self.spark, f"{self.root}/*/RESULTS").select("directory", F.lit("results").alias("kind"))
        kinds = self.files.select("directory", "kind").unionByName(results)
        return geology.model_index(self.decks.select("directory", "cluster", "seed", "centroid"), kinds, wells)


def history_tables(setups: DataFrame, connectivity: DataFrame, seeds: DataFrame | None) -> tuple[dict[str, DataFrame], list[DataFrame]]:
    """Compliance and misfit of two setups (setup, model_id, cluster_id, dev_...), and their axes: shares passed, misfit by cluster,
    and, with seeds (model_id, seed), the misfit's correlation with the connectivity of the seed's models."""
    names = sorted(r.setup for r in setups.select("setup").distinct().collect())  # two setups
    if len(names) != 2:
        raise ValueError(f"two setups are compared, not {names}")
    passed = geology.compliance(setups)
    summary, misfit = geology.compliance_summary(passed), geology.model_misfit(passed)
    axes = [geology.axis_compliance(summary, *names), geology.axis_misfit(misfit, *names)]
    if seeds is not None:
        metrics = ["n_bodies_26", "frac_sand_in_largest_26", "mean_inj_connections_per_producer"]
        means = connectivity.groupBy(F.col("seed").alias("_seed")).agg(*(F.avg(m).alias(m) for m in metrics))
        axes.append(geology.axis_cross(misfit.join(seeds.select("model_id", "seed"), "model_id").join(means, F.col("seed") == F.col("_seed")), metrics, old=names[0], new=names[1]))
    return {"compliance": summary, "misfit": misfit}, axes


def production_tables(rows: DataFrame, descriptors: DataFrame, draws: int) -> tuple[dict[str, DataFrame], list[DataFrame]]:
    """Uplift, coefficients and correlations of a table with seed, cluster, parameters p_... and responses r_..., and their axes."""
    parameters, responses = ([c for c in rows.columns if c.startswith(p)] for p in ("p_", "r_"))
    means = descriptors.groupBy(F.col("seed").alias("_seed")).agg(*(F.avg(c).alias(c) for c in geology.DESCRIPTORS))
    link = production.production_link(rows.join(means, F.col("seed") == F.col("_seed"), "left"), parameters, geology.DESCRIPTORS, responses, draws=draws)
    return link, [geology.axis_production(link["uplift"]), geology.axis_correlations(link["correlations"])]


def geology_tables(
    spark: SparkSession, roots: dict[int, str], out: str, cutoff: float | None = None, step: float = 1.0, history: str | None = None,
    seeds: str | None = None, production_rows: str | None = None, draws: int = 2000
) -> dict[str, DataFrame]:
    """Descriptors, connectivity and index of each experiment, written below out; their spreads and proportions; and of two
    experiments the matched seeds, the differences of their cubes and the comparison by axis: rebuild, connectivity, descriptors and
    diversity, with history (a Parquet table of two setups' deviations; with seeds, also against the connectivity) and production
    (a Parquet table of parameters and responses by seed) if these are given."""
    found = {n: Experiment(spark, root, n, f"{out}/work/experiment{n}", cutoff) for n, root in roots.items()}
    parts = {name: None for name in ("descriptors", "connectivity", "index")}
    for e in found.values():
        if e.grid is None:
            raise ValueError(f"no deck below {e.root} has a grid and its corners")
        for name in parts:
            t = getattr(e, name)()
            t = t if name != "index" else t.withColumn("experiment", F.lit(e.number).cast("long"))
            parts[name] = t if parts[name] is None else parts[name].unionByName(t)
    sinks.write_tables(parts, out)
    d, c, _ = (spark.read.parquet(f"{out}/{n}") for n in parts)
    more = {
        "descriptor_spread": geology.descriptor_spread(d), "connectivity_spread": geology.connectivity_spread(c),
        "proportions": geology.facies_proportions(d), "realism": geology.realism(d, geology.DESCRIPTORS)
    }
    if len(found) == 2:
        a, b = (found[n] for n in sorted(found))
        pairs = geology.matched_seeds(a.decks, b.decks)
        names = lambda e, n: e.decks.select(F.col("directory").alias(f"directory_{n}"), F.col("model").alias(f"model_{n}"))
        more["cube_difference"] = geology.cube_difference(
            a.all_cells(), b.all_cells(),
            pairs.join(names(a, "a"), "directory_a").join(names(b, "b"), "directory_b").select("seed", "model_a", "model_b")
        )
        spreads = more["descriptor_spread"].where("scope = 'all_wells'").drop("scope").unionByName(more["connectivity_spread"], True)
        more["width_ratio"] = geology.geological_width_ratio(spreads, a.number, b.number)
        rest = []
        if history:
            tables_, axes = history_tables(spark.read.parquet(history), c, spark.read.parquet(seeds) if seeds else None)
            more |= tables_
            rest += axes
        if production_rows:
            tables_, axes = production_tables(spark.read.parquet(production_rows), d, draws)
            more |= tables_
            rest += axes
        more["comparison"] = geology.summary_comparison(
            [
                geology.axis_rebuild(more["cube_difference"]), geology.axis_diversity(more["width_ratio"]), *rest,
                geology.axis_means(
                    c, "connectivity", {m: (F.avg(m), ">") for m in ("frac_sand_in_largest_26", "mean_inj_connections_per_producer")},
                    old=a.number, new=b.number
                ),
                geology.axis_means(
                    d, "descriptors", {m: (F.avg(m), ">") for m in ("net_sand_penetrated", "mean_ntg_along_well")}, old=a.number,
                    new=b.number
                )
            ]
        )
    sinks.write_tables(more, out)
    return parts | more
