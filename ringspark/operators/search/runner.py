"""Runs of searches over target tables: one task for each target, method and walker."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringspark.functions.bounds import moore_column
from ringspark.schema import MAX_STEPS, SEARCH_RESULT, TARGETS

from .methods import method


def targets(spark: SparkSession, *suites: str) -> DataFrame:
    """(suite, k, g, name, known_order, moore_bound) of the given suites, all by default."""
    rows = [t for t in TARGETS if not suites or t[0] in suites]
    table = spark.createDataFrame(rows, "suite string, k int, g int, name string, known_order int")
    return table.withColumn("moore_bound", moore_column(F.col("k"), F.col("g")))


def one(k: int, g: int, name: str, generator: str, walker: int, seed: int, max_steps: int, make: Callable | None = None) -> dict:
    """A result row of one search; an error is kept as text."""
    began = time.time()
    out = {"k": k, "g": g, "name": name, "generator": generator, "walker": walker, "success": False, "steps": 0, "final_n": 0, "final_girth": None, "error": None, "edges": []}
    try:
        search = (make or method(generator))(k, g, seed * 1_000_003 + walker)
        while not search.is_complete and search.step_count < max_steps:
            search.step()
        graph = search.graph
        girth = graph.girth()
        valid = graph.regular(k) and girth == g
        out |= {"success": bool(search.success and valid), "steps": search.step_count, "final_n": len(graph), "final_girth": None if girth == float("inf") else float(girth), "edges": [{"u": u, "v": v} for u, v in graph.edges()]}
        out |= {c: getattr(search, c, None) for c in ("explored", "duplicates")}
        if not search.is_complete:
            out["error"] = "out of steps"
    except Exception as e:  # a search may be anyone's class
        out["error"] = f"{type(e).__name__}: {e}"
    return out | {"time_seconds": time.time() - began}


def jobs(rows: DataFrame, generators: list[str], walkers: int = 1) -> DataFrame:
    """(k, g, name, generator, walker): every target with every generator and walker."""
    names = F.array(*(F.lit(g) for g in generators))
    return rows.select("k", "g", "name", F.explode(names).alias("generator")).select("*", F.explode(F.sequence(F.lit(0), F.lit(walkers - 1))).alias("walker"))


def run(rows: DataFrame, generators: list[str], max_steps: int = MAX_STEPS, walkers: int = 1, seed: int = 0, makers: dict[str, Callable] | None = None) -> DataFrame:
    """Results of every target (k, g, name) by every generator and walker, spread over the cluster.

    makers: further searches by name, any callable (k, g, seed) with step(), is_complete and graph.
    """
    spark, makers = rows.sparkSession, makers or {}
    plan = jobs(rows, generators, walkers)
    n =max(1, min(10_000, len(generators) * walkers * 8))

    def work(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                found = pd.DataFrame([one(r.k, r.g, r.name, r.generator, r.walker, seed, max_steps, makers.get(r.generator))]).reindex(columns=columns)
                yield found.astype({"explored": "Int64", "duplicates": "Int64"})

    columns = [c.name for c in spark.createDataFrame([], SEARCH_RESULT).schema]
    return plan.repartition(n,"k", "g", "generator", "walker").mapInPandas(work, SEARCH_RESULT)


def best_of_walkers(results: DataFrame) -> DataFrame:
    """The best walker of each target and generator: success, then fewest vertices and steps."""
    key = F.struct((~F.col("success")).alias("f"), "final_n", "steps", "walker")
    own = results.groupBy("k", "g", "generator").agg(F.min_by(F.struct(*(c for c in results.columns if c not in ("k", "g", "generator"))), key).alias("x"))
    return own.select("k", "g", "generator", "x.*")


def summary(results: DataFrame) -> DataFrame:
    """(generator, runs, successes, success_rate, mean_steps, median_steps) over the successes."""
    won = F.when(F.col("success"), F.col("steps"))
    return results.groupBy("generator").agg(F.count("*").alias("runs"), F.count_if("success").alias("successes"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg(won).alias("mean_steps"), F.median(won).alias("median_steps"))


#: Suites by the name of a preset.
PRESETS = {"small": ("small",), "medium": ("medium",), "large": ("large",), "all": ("small", "medium", "large")}


def preset(spark: SparkSession, name: str) -> DataFrame:
    """The targets of a preset."""
    if name not in PRESETS:
        raise ValueError(f"no such preset: {name}; there are {', '.join(PRESETS)}")
    return targets(spark, *PRESETS[name])


def compare(spark: SparkSession, suite: str, generators: list[str], max_steps: int = MAX_STEPS, seed: int = 0) -> DataFrame:
    return summary(run(preset(spark, suite), generators, max_steps, seed=seed))
