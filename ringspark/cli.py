"""Runs of searches from the command line: python -m ringspark.cli --suite small --generator astar."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ringspark.operators.search import runner
from ringspark.operators.search.methods import METHODS
from ringspark.schema import MAX_STEPS


def options(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Search for regular graphs of given girth")
    parser.add_argument("--suite", choices=sorted(runner.PRESETS), default="small")
    parser.add_argument("--generator", choices=[*METHODS, "all"], default="randomwalk")
    parser.add_argument("--max-steps", type=int, default=MAX_STEPS)
    parser.add_argument("--walkers", type=int, default=1)
    parser.add_argument("--seed", type=int, default=0)
    parser.add_argument("--verbose", action="store_true", help="a line for each search as well")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """The printed lines: searches if asked for, then a summary of each generator."""
    own = options(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    names = list(METHODS) if own.generator == "all" else [own.generator]
    found = runner.run(runner.preset(spark, own.suite), names, own.max_steps, own.walkers, own.seed).cache()
    lines = []
    if own.verbose:
        for r in found.orderBy("k", "g", "generator", "walker").collect():
            lines.append(f"({r.k},{r.g}) {r.generator} {r.walker}: {'found' if r.success else r.error or 'not found'}, {r.final_n} vertices, {r.steps} steps")
    for r in runner.summary(found).orderBy("generator").collect():
        lines.append(f"{r.generator}: {r.successes} of {r.runs}, mean steps {r.mean_steps}")
    found.unpersist()
    print("\n".join(lines))
    return lines


if __name__ == "__main__":
    main()
