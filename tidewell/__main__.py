"""python -m tidewell run|report|compare|geology ..."""

from __future__ import annotations

import argparse
from dataclasses import fields


def main(argv: list[str] | None = None) -> int:
    from tidewell.plans import phases
    from tidewell.session import build_session

    p = argparse.ArgumentParser(prog="tidewell")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("run", help="run one phase or all")
    r.add_argument("--phase", choices=["0", "1", "2", "3", "all"], default="all")
    r.add_argument("--study", required=True)
    r.add_argument("--out", required=True)
    for f in fields(phases.Config):
        flag = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            r.add_argument(flag, action="store_true")
        else:
            r.add_argument(flag, type=type(f.default), default=f.default)
    q = sub.add_parser("report", help="print an HTML report")
    q.add_argument("--out", required=True)
    c = sub.add_parser("compare", help="print phase 1 of several runs side by side")
    c.add_argument("outs", nargs="+", metavar="NAME=FOLDER")
    g = sub.add_parser("geology", help="descriptors, connectivity and comparison of folders of decks")
    g.add_argument("--out", required=True)
    g.add_argument("--cutoff", type=float, help="permeability of sand; calibrated for each deck if not given")
    g.add_argument("--step", type=float, default=1.0, help="distance of samples along a well")
    g.add_argument("--history", help="Parquet table of two setups' deviations (setup, model_id, cluster_id, dev_...)")
    g.add_argument("--seeds", help="Parquet table (model_id, seed) that links history to decks")
    g.add_argument("--production", help="Parquet table of parameters p_... and responses r_... by seed and cluster")
    g.add_argument("--draws", type=int, default=2000, help="resamples of the production link's intervals")
    g.add_argument("roots", nargs="+", metavar="NUMBER=FOLDER")
    a = p.parse_args(argv)
    spark = build_session()
    if a.command == "run":
        cfg = phases.Config(**{f.name: getattr(a, f.name) for f in fields(phases.Config)})
        for name, df in phases.run(spark, a.study, a.out, a.phase, cfg).items():
            print(name, df.columns)
    elif a.command == "geology":
        from tidewell.plans import experiment

        roots = {int(n): root for n, root in (x.split("=", 1) for x in a.roots)}
        for name, df in experiment.geology_tables(
            spark, roots, a.out, a.cutoff, a.step, a.history, a.seeds, a.production, a.draws
        ).items():
            print(name, df.columns)
    elif a.command == "report":
        print(phases.report(spark, a.out))
    else:
        for name, df in phases.compare_phase1(spark, dict(x.split("=", 1) for x in a.outs)).items():
            print(name)
            df.show(100, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
