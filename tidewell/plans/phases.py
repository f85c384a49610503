"""The study's phases over canonical tables: ingest, update with checks, selection with proxies, ablation, comparison, report.

A study is a folder of Parquet tables: members, theta, sim, observed (with or
without sigma) and forecast, as in tidewell.schemas; each phase reads the
tables it needs and writes its results below the output folder.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import geology, linear, members, series
from tidewell.schemas import nan_to_null, violations
from tidewell.sources import sinks
from tidewell.sources.tables import exists


@dataclass(frozen=True)
class Config:
    mode: str = "cumulative"
    factor: float = 3.0
    method: str = "hard"
    energy: float = 0.99
    seed: int = 42
    clip_to_prior: bool = False
    dedup: bool = False
    keep_outside: bool = False
    hindcast: bool = False
    train_years: int = 6
    val_years: int = 2
    top_x: int = 30
    validation_n: int = 15
    val_fraction: float = 0.2


def _read(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [nan_to_null(spark.read.parquet(f"{folder}/{n}")) for n in names]


def phase0(spark: SparkSession, study: str, out: str, cfg: Config) -> dict[str, DataFrame]:
    """Check the study's tables: no missing value, no repeated key; observations get their noise."""
    m, t, s, o = _read(spark, study, "members", "theta", "sim", "observed")
    bad = violations(t, ["member_id", "comp"], ["value"]).first()
    worse = violations(s, ["member_id", "kind", "metric", "well", "time"], ["value"]).first()
    if sum(bad) or sum(worse):
        raise ValueError(f"the study has missing values or repeated keys: {bad}, {worse}")
    o = o if "sigma" in o.columns else series.diag_sigma(o)
    tables = {"members": m, "theta": t, "sim": s, "observed": o}
    sinks.write_tables(tables, f"{out}/phase0")
    return tables


def _data(sim: DataFrame, observed: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Series and observations of the mode; in a hindcast the training years, and the validation years beside them."""
    d = series.build_d(sim, cfg.mode)
    if not cfg.hindcast:
        return d, observed, None
    split = series.split_history(d, cfg.train_years, cfg.val_years)
    keep = ["kind", "metric", "well", "time"]
    train = split.where("split = 'train'").drop("split")
    return train, observed.join(train.select(*keep).distinct(), keep, "left_semi"), split.where("split = 'val'").drop("split")


def phase1(spark: SparkSession, study: str, out: str, cfg: Config) -> dict[str, DataFrame]:
    """Localized update of the parameters, and its checks."""
    m, t, s, o = _read(spark, f"{out}/phase0", "members", "theta", "sim", "observed")
    d, obs, _ = _data(s, o, cfg)
    keys = ["kind", *series.KEY]
    mask = linear.localization(linear.correlation(t, d, keys), cfg.factor, cfg.method)
    post = linear.ensemble_update(t, d, obs, mask, cfg.energy, cfg.seed, keys=keys)
    post = post.join(t.select("member_id", "comp", "cluster_id", "model_id"), ["member_id", "comp"])
    if cfg.clip_to_prior:
        post = members.clip_to_prior(post, t).drop("clipped")
    sinks.write_table(post, f"{out}/phase1/theta_post")
    (post,) = _read(spark, f"{out}/phase1", "theta_post")
    full = linear.component_rank(t).first()
    spread, bounds, dup = members.spread_retention(t, post), members.physical_bounds(t, post), members.duplicate_models(m, t, post)
    n, k, rank = t.select("member_id").distinct().count(), t.select("comp").distinct().count(), full["rank"]
    bi = members.bimodality(post, ["comp"]).agg(F.max("bimodality")).first()[0]
    msgs = members.messages(spread, bounds, dup, rank, n, k, bi)
    misfit = series.misfit(d, obs, keys)
    tables = {
        "localization": mask, "localization_summary": linear.localization_summary(mask), "spread": spread,
        "centroids": members.centroid_shift(t, post), "migration": members.cluster_migration(t, post), "misfit": misfit,
        "misfit_summary": series.misfit_summary(misfit), "messages": msgs, "bounds": bounds, "duplicates": dup
    }
    sinks.write_qc(tables, {"rank": rank, "full": full["full"]}, f"{out}/phase1/qc")
    sinks.write_sidecar(spark, f"{out}/phase1/theta_post", "theta_post", asdict(cfg), cfg.seed)
    return {"theta_post": post, **tables}


def phase2(spark: SparkSession, study: str, out: str, cfg: Config) -> dict[str, DataFrame]:
    """Rank members by their change, plan re-simulation, fit and validate proxies, and project the posterior."""
    m, t, s, o = _read(spark, f"{out}/phase0", "members", "theta", "sim", "observed")
    (post,) = _read(spark, f"{out}/phase1", "theta_post")
    dist = linear.mahalanobis(t, post).join(m, "member_id")
    if cfg.dedup:
        dist = geology.first_rows(dist, ["model_id"], ["ord"])
    ranking = members.rank_members(dist)
    plan = members.plan_resimulation(ranking, cfg.top_x, cfg.validation_n, cfg.seed)
    sinks.write_plan(plan, f"{out}/phase2/plan")
    target = _data(s, o, cfg)[2] if cfg.hindcast else _read(spark, study, "forecast")[0]
    train = t.join(dist.select("member_id"), "member_id", "left_semi") if cfg.dedup else t
    target = target.join(train.select("member_id").distinct(), "member_id", "left_semi")
    fitted = sinks.write_table(linear.build_proxies(train, target), f"{out}/phase2/proxies")
    projected = linear.predict(spark.read.parquet(fitted), post)
    # how far the proxies are to be trusted: fitted without a share of each cluster's members, and held against these
    split = members.stratified_split(train.select("member_id", "cluster_id").distinct(), cfg.val_fraction, cfg.seed)
    sinks.write_table(linear.proxy_errors(train, target, split), f"{out}/phase2/proxy_errors")
    (errors,) = _read(spark, f"{out}/phase2", "proxy_errors")
    tables = {"ranking": ranking, "projection": projected, "proxy_validation": linear.validate_proxy(train, target, split, errors=errors)}
    sinks.write_tables(tables, f"{out}/phase2")
    sinks.write_sidecar(spark, f"{out}/phase2/projection", "projection", asdict(cfg), cfg.seed)
    return tables | {"plan": plan, "proxy_errors": errors}


def phase3(spark: SparkSession, study: str, out: str, cfg: Config) -> dict[str, DataFrame]:
    """Three setups against the truth: quantiles, ratios, shifts, scores, coverage, errors and the summary."""
    s, o = _read(spark, f"{out}/phase0", "sim", "observed")
    (projected,) = _read(spark, f"{out}/phase2", "projection")
    prior = _data(s, o, cfg)[2] if cfg.hindcast else _read(spark, study, "forecast")[0]
    truth = o if cfg.hindcast else _read(spark, study, "truth")[0]
    truth = truth.join(prior.select(*series.KEY).distinct(), series.KEY, "left_semi").select(*series.KEY, "d_obs").dropDuplicates(series.KEY)
    parts = F.split("pos", r"\|")
    proxy = projected.where("predicted is not null").select(
        "member_id", parts[0].alias("metric"), parts[1].alias("well"), parts[2].cast("long").alias("time"),
        F.col("predicted").alias("value"), "in_envelope"
    )
    inside = None if cfg.keep_outside else proxy.where("in_envelope").select("member_id").distinct()
    setups = series.build_setups(prior, proxy, inside)
    sinks.write_table(setups, f"{out}/phase3/setups")
    (setups,) = _read(spark, f"{out}/phase3", "setups")
    by = {n: setups.where(F.col("setup") == n) for n in ("setup1", "setup2", "setup3")}
    summary = series.metrics_summary(by, prior, truth).select(F.lit("hindcast" if cfg.hindcast else "forecast").alias("evaluation_mode"), "*")
    tables = {"summary": summary, "latex": geology.latex_rows(summary)}
    for n, d in by.items():
        tables |= {
            f"{n}_field": series.field_total_quantiles(d), f"{n}_metrics": series.metric_table(d, prior, truth),
            f"{n}_error": series.cumulative_error(d, truth)
        }
    sinks.write_tables(tables, f"{out}/phase3")
    return tables


def run(spark: SparkSession, study: str, out: str, phase: str = "all", cfg: Config = Config()) -> dict[str, DataFrame]:
    steps = {"0": phase0, "1": phase1, "2": phase2, "3": phase3}
    result: dict[str, DataFrame] = {}
    for p in steps if phase == "all" else [phase]:
        result = steps[p](spark, study, out, cfg)
    return result


def compare_phase1(spark: SparkSession, variants: dict[str, str]) -> dict[str, DataFrame]:
    """Spread and centroids of several runs side by side, by component and by cluster and component."""
    read = lambda out, n: spark.read.option("header", True).csv(f"{out}/phase1/qc/{n}", inferSchema=True)
    return {
        "spread": members.align({k: read(o, "spread") for k, o in variants.items()}, ["comp"], "ratio"),
        "centroids": members.align({k: read(o, "centroids") for k, o in variants.items()}, ["cluster_id", "comp"], "shift_sigma")
    }


#: Tables of the report, in its order; those that a run has not written are left out.
REPORT = {
    "phase3": ["summary", "latex", *(f"setup{n}_{t}" for n in (1, 2, 3) for t in ("field", "metrics", "error"))],
    "phase2": ["ranking", "proxy_validation", "proxy_errors"],
    "phase2/plan": ["resimulate", "proxy_pool", "validation"],
    "phase1/qc": ["messages", "spread", "centroids", "migration", "localization_summary", "misfit_summary", "bounds", "duplicates"],
}


def report(spark: SparkSession, out: str) -> str:
    """HTML of the phases' small tables."""
    found = {}
    for folder, names in REPORT.items():
        for n in names:
            path = f"{out}/{folder}/{n}"
            if exists(spark, path):
                csv = folder in ("phase1/qc", "phase2/plan")
                found[f"{folder}/{n}"] = spark.read.option("header", True).csv(path) if csv else spark.read.parquet(path)
    return sinks.html_report("Study", found)
