"""Planner experiments from the command line; all planners must give the same answer.

    python -m orweave.experiments synthetic --data /tmp/t --sweep clauses --out clauses.csv
    python -m orweave.experiments suite --data /root/testdata/sf0.1 --out suite.csv
"""

from __future__ import annotations

import argparse
import csv
import itertools
import os
from dataclasses import asdict, replace

from pyspark.sql import SparkSession

from orweave.engine import Config, Engine
from orweave.plans.workload import Star
from orweave.sources.synthetic import write_synthetic
from orweave.suite import PLANNED

CNF_PLANNERS = ("basic_no_opt", "tagged_pushdown", "tagged_pullup", "tagged_iter_pushdown", "tagged_combined")
DNF_PLANNERS = ("basic_disj", *CNF_PLANNERS[1:])
ALL_PLANNERS = ("basic", "basic_disj", "tagged_pushdown", "tagged_pullup", "tagged_iter_pushdown", "tagged_conj_pushdown", "tagged_combined")
#: Fixed values of the published experiments.
SWEEPS = {
    "clauses": [{"clauses": n} for n in range(2, 8)],
    "tables": [{"rows": 1e2, "tables": n} for n in range(3, 7)],
    "selectivity": [{"selectivity": n / 10} for n in range(1, 10)],
    "redundancy": [{"clauses": 5, "redundant": n} for n in range(5)],
    "outer": [{"outer": n / 10} for n in range(1, 11)],
    "rows": [{"rows": n} for n in (1e3, 2e3, 5e3, 1e4, 2e4, 5e4)],
}


def compare(engine: Engine, sql: str, planners: tuple[str, ...], trials: int):
    """Measures of every planner, interleaved over the trials; raises where answers differ."""
    answers = {}
    for trial, planner in itertools.product(range(trials), planners):
        found = engine.run(sql, planner).collect()
        answers.setdefault(repr(sorted(map(repr, found))), planner)
        if len(answers) > 1:
            raise AssertionError(f"{' and '.join(answers.values())} differ on {sql}")
        yield {"trial": trial, **asdict(engine.measure(sql, planner))}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="orweave.experiments")
    parser.add_argument("kind", choices=["synthetic", "suite"])
    parser.add_argument("--data", required=True)
    parser.add_argument("--sweep", choices=SWEEPS, default="clauses")
    parser.add_argument("--cnf", action="store_true")
    parser.add_argument("--trials", type=int, default=3)
    parser.add_argument("--points", type=int, help="only so many points of the sweep")
    parser.add_argument("--out", required=True)
    a = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.kind == "synthetic" and not os.path.exists(a.data):
        write_synthetic(spark, a.data)
    engine, rows = Engine(spark, a.data, Config()), []
    if a.kind == "synthetic":
        for point in SWEEPS[a.sweep][: a.points]:
            planners = CNF_PLANNERS if a.cnf else DNF_PLANNERS
            planners = ("basic", *planners) if a.cnf and "outer" in point else planners
            rows += [{**point, **m} for m in compare(engine, replace(Star(cnf=a.cnf), **point).sql(), planners, a.trials)]
    else:
        for name, sql in PLANNED.items():
            planners = tuple(p for p in ALL_PLANNERS if p != "basic_disj" or name in ("dnf", "wide"))
            rows += [{"query": name, **m} for m in compare(engine, sql, planners, a.trials)]
    with open(a.out, "w", newline="") as f:
        out = csv.DictWriter(f, list(rows[0]))
        out.writeheader()
        out.writerows(rows)


if __name__ == "__main__":
    main()
