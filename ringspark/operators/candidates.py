"""Candidate edges, successors and choices among actions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringspark.functions import drawing, score
from ringspark.functions.basic import uniform

from . import distances, sampling
from .edits import add_edges, one_each
from .indexes import numbered
from .lineage import held
from .metrics import degrees

PAIR = ["graph_id", "u", "v"]
#: Vertices of a block; a block is listed against one vertex at a time.
BLOCK = 2_048
#: Close vertices of a block, at most, that each pair is compared with; more are taken out at once.
FEW = 32
#: Draws that a task holds at once.
DRAWS = 65_536


def low_blocks(vertices: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(graph_id, node_id, degree, block, last): vertices below degree k, in blocks of their sorted ids."""
    low = numbered(degrees(vertices, edges).filter(F.col("degree") < k), ["graph_id"], ["node_id"], "idx", "n")
    of = lambda c: F.floor(c / BLOCK).cast("int")
    return held(low.select("graph_id", "node_id", "degree", of(F.col("idx")).alias("block"), of(F.col("n") - 1).alias("last")), "low")


def listed(low: DataFrame, close: DataFrame, worth: DataFrame | None = None) -> DataFrame:
    """(graph_id, u, v, degree_u, degree_v): pairs of ``low`` with u < v, without those (graph_id, u, v, ...) in ``close``.

    worth: (graph_id, degree_u, degree_v, ...) whose further columns the pairs take on.  Vertices meet
    blocks, not vertices: a block's vertices of one degree are an array, and a vertex is shuffled once
    for each block of its graph, with its close ones there.  All but v is known before the array is
    taken apart, which is the last step; pairs are never written.
    """
    spark = low.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    keys = ["graph_id", "block_u", "block_v"]
    at = close.join(low.select("graph_id", F.col("node_id").alias("v"), F.col("block").alias("block_v")), ["graph_id", "v"])
    own = at.groupBy("graph_id", "u", "block_v").agg(F.collect_list("v").alias("own"))
    a = low.select("graph_id", F.col("node_id").alias("u"), F.col("degree").alias("degree_u"), F.col("block").alias("block_u"), F.explode(F.sequence("block", "last")).alias("block_v")).join(own, ["graph_id", "u", "block_v"], "left")
    b = low.groupBy("graph_id", F.col("degree").alias("degree_v"), F.col("block").alias("block_v")).agg(F.collect_list("node_id").alias("vs")).withColumn("block_u", F.explode(F.sequence(F.lit(0), "block_v")))
    both = a.repartition(tasks, *keys).join(b.repartition(tasks, *keys), keys)
    if worth is not None:
        both = both.join(F.broadcast(worth), ["graph_id", "degree_u", "degree_v"])
    many = F.size("own") > FEW
    both = both.withColumns({"vs": F.when(many, F.array_except("vs", "own")).otherwise(F.col("vs")), "own": F.when(~many, F.col("own"))})
    kept = [c for c in both.columns if c not in (*keys, "u", "vs", "own")]
    return both.select("graph_id", "u", F.explode("vs").alias("v"), *kept, "own").filter("u < v and not coalesce(array_contains(own, v), false)").drop("own")


def barred(close: DataFrame, g: int) -> DataFrame:
    """``close`` with distance 0 for the pairs whose edge would close a cycle shorter than g."""
    return close.withColumn("distance", F.when(F.col("distance") > g - 2, F.col("distance")).otherwise(0))


def pairs(vertices: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Unordered pairs of vertices below degree k that no edge joins."""
    joined = edges.filter("u <> v").select("graph_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.lit(0).alias("distance")).distinct()
    return listed(low_blocks(vertices, edges, k), joined)


def safe_pairs(vertices: DataFrame, edges: DataFrame, k: int, g: int) -> DataFrame:
    """Pairs as of :func:`pairs` and :func:`girth_safe`; only those too close are sought, by balls of g - 2 steps."""
    low = low_blocks(vertices, edges, k)
    return listed(low, distances.within(edges, low, g - 2))


def girth_safe(candidates: DataFrame, edges: DataFrame, g: int) -> DataFrame:
    """Pairs whose edge closes no cycle shorter than g: over g - 2 steps apart."""
    close = distances.asked(edges, candidates, g - 2)
    return candidates.join(close.select(*PAIR), PAIR, "left_anti")


def sampled_pairs(vertices: DataFrame, edges: DataFrame, k: int, g: int, seed: int = 0, most: int = 50) -> DataFrame:
    """Of each graph up to min(most, n^2) different safe pairs of vertices below degree k.

    Pairs are drawn first and tested after, so no table of pairs is built; see :mod:`.sampling`.
    """
    n = vertices.groupBy("graph_id").agg(F.count_distinct("node_id").alias("n")).select("graph_id", F.least(F.col("n") * F.col("n"), F.lit(most)).cast("bigint").alias("most"))
    low = held(degrees(vertices, edges).filter(F.col("degree") < k).select("graph_id", "node_id"), "low")
    passing = lambda drawn: girth_safe(drawn.join(edges.select(*PAIR), PAIR, "left_anti"), edges, g)
    return sampling.pairs(low, most, seed, passing, n).select(*PAIR)


def add_low_edge(vertices: DataFrame, edges: DataFrame, k: int, g: int, seed: int = 0) -> DataFrame:
    """Edges with one more in each graph that has a safe pair of vertices below degree k."""
    low = low_blocks(vertices, edges, k)
    return add_edges(edges, least_drawn(low, barred(distances.within(edges, low, g - 2), g), seed))


def least_drawn(low: DataFrame, close: DataFrame, seed: int, held_at_once: float = DRAWS) -> DataFrame:
    """(graph_id, u, v) as of :func:`one_each` over the pairs of ``low`` that are not at distance 0 in ``close``.

    Every pair is drawn, but none is a row: a task draws the pairs of two blocks in arrays of about
    ``held_at_once`` numbers, and gives back the least.
    """
    spark = low.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    of = lambda x: low.select("graph_id", F.col("node_id").alias(x), F.col("block").alias(f"block_{x}"))
    keys = ["graph_id", "block_u", "block_v"]
    unsafe = close.filter("distance = 0").join(of("u"), ["graph_id", "u"]).join(of("v"), ["graph_id", "v"])
    own = unsafe.groupBy(*keys).agg(F.collect_list(F.struct("u", "v")).alias("own")).select(*keys, F.col("own.u").alias("not_u"), F.col("own.v").alias("not_v"))
    block = held(low.groupBy("graph_id", "block", "last").agg(F.sort_array(F.collect_list("node_id")).alias("ids")), "blocks")
    a = block.select("graph_id", F.col("block").alias("block_u"), F.explode(F.sequence("block", "last")).alias("block_v"), F.col("ids").alias("us"))
    b = block.select("graph_id", F.col("block").alias("block_v"), F.col("ids").alias("vs"))
    met = a.join(b, ["graph_id", "block_v"]).join(own, keys, "left").repartition(tasks, *keys)
    met = met.select("graph_id", "us", "vs", *(F.coalesce(c, F.array().cast("array<bigint>")).alias(c) for c in ("not_u", "not_v")))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py()
                us, vs, not_u, not_v = (batch.column(c)[i].values.to_numpy() for c in range(1, 5))
                if (found := drawing.least(f"{seed}:{name}:", us, vs, not_u, not_v, max(1, int(held_at_once)))) is not None:
                    yield pa.RecordBatch.from_pylist([dict(zip(("graph_id", "draw", "u", "v"), (name, *found), strict=True))], schema=drawn)

    drawn = pa.schema([("graph_id", pa.string()), ("draw", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])
    found = met.mapInArrow(kernel, "graph_id string, draw bigint, u bigint, v bigint")
    return found.groupBy("graph_id").agg(F.min(F.struct("draw", "u", "v")).alias("x")).select("graph_id", "x.u", "x.v")


def sampled_actions(vertices: DataFrame, edges: DataFrame, k: int, g: int, seed: int = 0) -> DataFrame:
    """(graph_id, type, u, v): a new vertex, sampled safe pairs, up to 3 edges and 2 vertices to remove."""
    none = F.lit(None).cast("bigint")
    as_rows = lambda df, kind, u, v: df.select("graph_id", F.lit(kind).alias("type"), u.alias("u"), v.alias("v"))
    out = as_rows(vertices.select("graph_id").distinct(), "add_vertex", none, none)
    out = out.union(as_rows(sampled_pairs(vertices, edges, k, g, seed), "add_edge", F.col("u"), F.col("v")))
    out = out.union(as_rows(one_each(edges, ["u", "v"], seed, 3), "remove_edge", F.col("u"), F.col("v")))
    return out.union(as_rows(one_each(vertices, ["node_id"], seed, 2), "remove_vertex", F.col("node_id"), none))


def judged(low: DataFrame, edges: DataFrame, g: int, rows: DataFrame) -> DataFrame:
    """The close pairs of ``low`` that tell scores apart, with their distance, 0 for the unsafe ones; rows: figures.

    The cycle of a new edge is the lesser of girth and distance + 1, and a score only asks whether it
    is under, at or over the goal: farther pairs score as if no path joined them.
    """
    least = F.when(F.col("girth") < F.col("g"), 0).when(F.col("girth") == F.col("g"), F.col("g") - 2).otherwise(F.col("g") - 1)
    return held(barred(distances.within(edges, low, rows.select("graph_id", F.greatest(least, F.lit(g - 2)).alias("depth"))), g), "close")


def scores(found: DataFrame, rows: DataFrame, digits: int | None = None) -> DataFrame:
    """``found`` (graph_id, degree_u, degree_v, distance, ...) with the score of adding such an edge; rows: figures of the graphs."""
    columns = [F.col(c) for c in found.columns]
    found = found.join(F.broadcast(rows), "graph_id")
    k, after = F.col("k"), lambda x: F.col(f"degree_{x}") + 1
    done = F.col("share") * F.col("n") + sum(F.when(after(x) == k, 1).when(after(x) == k + 1, -1).otherwise(0) for x in "uv")
    cycle = F.least("girth", F.col("distance") + 1)  # null only if neither is there
    quality = score.quality(F.col("n"), done / F.col("n"), cycle, F.col("mb"), F.col("g"))
    value = score.add_edge(quality, after("u"), after("v"), k)
    return found.select(*columns, (value if digits is None else F.round(value, digits)).alias("score"))


def scored_edges(vertices: DataFrame, edges: DataFrame, k: int, g: int, rows: DataFrame, digits: int | None = None) -> DataFrame:
    """(graph_id, u, v, score) of adding each safe pair of vertices below degree k; rows: figures of the graphs.

    Pairs that are not close score alike by their degrees: a graph scores, and rounds, each two degrees once.
    """
    low = low_blocks(vertices, edges, k)
    close = judged(low, edges, g, rows)
    of = lambda x: low.select("graph_id", F.col("degree").alias(f"degree_{x}")).distinct()
    kinds = of("u").join(of("v"), "graph_id").withColumn("distance", F.lit(None).cast("int"))
    far = listed(low, close, held(scores(kinds, rows, digits).drop("distance"), "worth"))
    u, v = (low.select("graph_id", F.col("node_id").alias(x), F.col("degree").alias(f"degree_{x}")) for x in "uv")
    near = scores(close.filter("distance > 0").join(u, ["graph_id", "u"]).join(v, ["graph_id", "v"]), rows, digits)
    return far.select(*PAIR, "score").union(near.select(*PAIR, "score"))


def last_edges(vertices: DataFrame, edges: DataFrame, k: int, g: int, rows: DataFrame) -> DataFrame:
    """Of :func:`scored_edges` the last pair (greatest u, then v) of each graph, degrees and distance: all that can be best.

    No pairs are listed.  For a vertex and a degree, the greatest vertex of that degree that is not
    close is the first one whose place, from the greatest down, no close one has.
    """
    low = low_blocks(vertices, edges, k)
    close = judged(low, edges, g, rows)
    placed = held(numbered(low.select("graph_id", "node_id", "degree"), ["graph_id", "degree"], ["node_id"], "idx", "n").select("graph_id", "node_id", "degree", (F.col("n") - F.col("idx")).alias("place")), "placed")
    u, v = (placed.select("graph_id", F.col("node_id").alias(x), F.col("degree").alias(f"degree_{x}"), *([F.col("place")] if x == "v" else [])) for x in "uv")
    order = Window.partitionBy("graph_id", "u", "degree_v").orderBy("place")
    met = close.join(v, ["graph_id", "v"]).withColumn("turn", F.row_number().over(order))
    taken = met.filter("place = turn").groupBy("graph_id", "u", "degree_v").agg((F.count("*") + 1).alias("place"))
    asked = u.join(v.select("graph_id", "degree_v").distinct(), "graph_id").join(taken, ["graph_id", "u", "degree_v"], "left").fillna(1, ["place"])
    far = asked.join(v, ["graph_id", "degree_v", "place"]).filter("u < v").withColumn("distance", F.lit(None).cast("int"))
    near = close.filter("distance > 0").join(u, ["graph_id", "u"]).join(v, ["graph_id", "v"])
    columns = ["graph_id", "u", "v", "degree_u", "degree_v", "distance"]
    kind = ["graph_id", "degree_u", "degree_v", "distance"]
    last = far.select(*columns).union(near.select(*columns)).groupBy(*kind).agg(F.max(F.struct("u", "v")).alias("x"))
    return scores(last.select(*kind, "x.u", "x.v"), rows).select(*PAIR, "score")


def actions(scored: DataFrame, rows: DataFrame) -> DataFrame:
    """All scored actions: an edge for each pair, and a new vertex while n < 2 mb."""
    vertex = rows.filter("n < 2 * mb").select("graph_id", F.lit("add_vertex").alias("type"), F.lit(None).cast("bigint").alias("u"), F.lit(None).cast("bigint").alias("v"), score.add_vertex(F.col("n"), F.col("mb")).alias("score"))
    return scored.select("graph_id", F.lit("add_edge").alias("type"), "u", "v", "score").unionByName(vertex)


def greedy(rows: DataFrame) -> DataFrame:
    """The action taken first in each graph: best score, the last one among ties."""
    order = Window.partitionBy("graph_id").orderBy(F.desc("score"), F.desc(F.col("type") == "add_edge"), F.desc("u"), F.desc("v"))
    return rows.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def policies(rows: DataFrame) -> DataFrame:
    """(graph_id, ordinal, action, p): the probabilities of a random step's actions; rows: figures."""
    weights = score.policy(F.col("low"), F.col("high"), F.floor(F.col("n") * F.col("k") / 2) - F.col("m"), F.col("n"), F.col("mb"))
    table = F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(a).alias("action"), weights[a].alias("w")) for i, a in enumerate(score.ACTIONS)))
    long = rows.select("graph_id", F.explode(table).alias("x")).select("graph_id", "x.*").filter("w > 0")
    return long.select("graph_id", "ordinal", "action", (F.col("w") / F.sum("w").over(Window.partitionBy("graph_id"))).alias("p"))


def weighted_choice(table: DataFrame, seed: int = 0) -> DataFrame:
    """One action for each graph: the first whose cumulative probability passes the draw."""
    order = Window.partitionBy("graph_id").orderBy("ordinal")
    up_to = F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0))
    passed = table.withColumn("up_to", up_to).filter(F.col("up_to") > uniform(F.lit(seed), F.col("graph_id")))
    return passed.groupBy("graph_id").agg(F.min_by("action", "ordinal").alias("action"))


def best_mean(children: DataFrame) -> DataFrame:
    """(parent, child) of greatest mean value, 0 without visits, the first child among ties."""
    mean = F.when(F.col("visits") > 0, F.col("value") / F.col("visits")).otherwise(0.0)
    return children.groupBy("parent").agg(F.min_by("child", F.struct((-mean).alias("b"), "child")).alias("child"))


def best_child(children: DataFrame, c: float = 0.5) -> DataFrame:
    """(parent, child) of greatest upper confidence bound, the first child among ties.

    children: (parent, child, visits, value, parent_visits).
    """
    bound = score.ucb1(F.col("value"), F.col("visits"), F.col("parent_visits"), c)
    return children.groupBy("parent").agg(F.min_by("child", F.struct((-bound).alias("b"), "child")).alias("child"))
