"""Random pairs of vertices without a table of pairs.

The pairs (i, j), i < j, of m vertices have the ranks  j (j - 1) / 2 + i.  A keyed permutation of
the ranks says in which order they are drawn: four rounds of a Feistel network over the least
power of 4 that holds all ranks, leaving out numbers beyond the last rank.  A draw is turned back
into its two vertices by a root.  Draws are made and tested in blocks that grow by GROWTH, until
each graph has enough pairs that pass or no rank is left, so the work follows the sample and what
it takes to fill it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringspark.functions.basic import uniform

from .indexes import numbered
from .lineage import held

ROUNDS, GROWTH = 4, 8


def permuted(number: Column, half: Column, seed: int, key: Column) -> Column:
    """A permutation of the numbers under 2^(2 * half), another one for each seed and key."""
    size = F.pow(F.lit(2.0), half).cast("bigint")
    start = F.struct(F.floor(number / size).cast("bigint").alias("l"), F.pmod(number, size).alias("r"))

    def turned(x: Column, turn: Column) -> Column:
        mask = F.floor(uniform(F.lit(seed), key, turn, x["r"]) * size)
        return F.struct(x["r"].alias("l"), x["l"].bitwiseXOR(mask).cast("bigint").alias("r"))

    # a fold over the rounds, as an expression of all rounds would repeat itself
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turned, lambda x: x["l"] * size + x["r"])


def unranked(rank: Column) -> tuple[Column, Column]:
    """(i, j) of a rank; the root may be off by one for large ranks, which is put right."""
    near = F.floor((1 + F.sqrt(1.0 + 8.0 * rank.cast("double"))) / 2).cast("bigint")
    base = lambda j: F.shiftright(j * (j - 1), 1)
    j = F.when(base(near) > rank, near - 1).when(base(near + 1) <= rank, near + 1).otherwise(near)
    return (rank - base(j)).cast("bigint"), j.cast("bigint")


def pairs(vertices: DataFrame, most: int, seed: int, passing: Callable[[DataFrame], DataFrame], limit: DataFrame | None = None) -> DataFrame:
    """(graph_id, u, v, place): of each graph the first ``most`` drawn pairs that pass, or all if fewer do.

    vertices: (graph_id, node_id), each once; passing: keeps rows (graph_id, u, v) that may be
    taken; limit: (graph_id, most) where a graph has a bound of its own.
    """
    spots = held(numbered(vertices.select("graph_id", "node_id"), ["graph_id"], ["node_id"], "i", "n"), "spots")
    sizes = spots.groupBy("graph_id").agg(F.max("n").alias("n")).filter("n > 1")
    count = (F.col("n") * (F.col("n") - 1) / 2).cast("bigint")
    half = F.ceil(F.log2(F.col("ranks").cast("double")) / 2)
    sizes = sizes.select("graph_id", count.alias("ranks")).select("graph_id", "ranks", F.greatest(half, F.lit(1)).cast("int").alias("half"))
    sizes = sizes.join(limit.select("graph_id", "most"), "graph_id", "left") if limit is not None else sizes.withColumn("most", F.lit(None).cast("bigint"))
    pending = held(sizes.select("graph_id", "ranks", "half", F.coalesce("most", F.lit(most)).cast("bigint").alias("most"), F.lit(0).cast("bigint").alias("have")).filter("most > 0"), "graphs")
    taken, start, step = [], 0, 4 * most
    by_place = spots.select("graph_id", "node_id", "i")
    while not pending.isEmpty():
        top = F.pow(F.lit(4.0), F.col("half")).cast("bigint")
        turns = pending.filter(top > start).select("*", F.explode(F.sequence(F.lit(start).cast("bigint"), F.least(top, F.lit(start + step)) - 1)).alias("turn"))
        drawn = turns.withColumn("rank", permuted(F.col("turn"), F.col("half"), seed, F.col("graph_id"))).filter("rank < ranks")
        i, j = unranked(F.col("rank"))
        drawn = drawn.select("graph_id", "turn", "have", "most", i.alias("i"), j.alias("j"))
        for number, end in (("i", "u"), ("j", "v")):
            drawn = drawn.join(by_place.select("graph_id", F.col("i").alias(number), F.col("node_id").alias(end)), ["graph_id", number])
        drawn = held(drawn.select("graph_id", "u", "v", "turn", "have", "most"), "drawn")
        passed = drawn.join(passing(drawn.select("graph_id", "u", "v")).select("graph_id", "u", "v"), ["graph_id", "u", "v"], "left_semi")
        place = F.col("have") + F.row_number().over(Window.partitionBy("graph_id").orderBy("turn"))
        now = held(passed.withColumn("place", place).filter("place <= most").select("graph_id", "u", "v", F.col("place").cast("bigint").alias("place")), "taken")
        taken.append(now)
        have = now.groupBy("graph_id").agg(F.max("place").alias("now"))
        pending = held(
            pending.join(have, "graph_id", "left").select("graph_id", "ranks", "half", "most", F.coalesce("now", "have").alias("have")).filter((F.col("have") < F.col("most")) & (F.pow(F.lit(4.0), F.col("half")) > start + step)), "graphs"
        )
        start, step = start + step, GROWTH * step
    if not taken:
        return spots.select("graph_id", F.col("node_id").alias("u"), F.col("node_id").alias("v"), F.lit(0).cast("bigint").alias("place")).limit(0)
    out = taken[0]
    for rows in taken[1:]:
        out = out.union(rows)
    return out
