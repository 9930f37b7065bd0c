"""Girth of graphs of any size by contraction, as joins and groupings of edge tables.

Edges carry weights, at first 1.  In each round an independent set of thin vertices is chosen:
those of degree 1 or 2 whose hash is less than that of their thin neighbours.  A chosen leaf goes
with its edge; a chosen vertex of degree 2 gives way to one edge between its neighbours with the
sum of both weights.  Where that edge has a rival between the same ends, both together are a
cycle, and only the lighter one stays: it can replace the other in every other cycle.  At least a
part of the thin vertices goes in each round, so rings, paths and hanging trees of any length are
gone after a number of rounds that grows with the logarithm of their size.

What is left is a core whose vertices have three neighbours or more.  There, paths grow from all
roots at once, a step a round; a path to a vertex that another path of the same root reaches too
is a cycle.  Only vertices that come after the root are entered, in the order of falling degrees:
each cycle has a first vertex, and no root has to look behind the hubs before it.  A path that
is at least half as long as the best cycle so far is given up.  A search from a few roots of each
graph alone comes first, so that this bound is there from the start.  A core has no parallel edges,
so nothing is shorter than a cycle of three, and only a triangle is shorter than one of four: these
graphs are settled by :func:`triangles`, through no more paths than those that rise in the order.

Every round is a table in the shared folder, keyed by graph and vertex or by root and vertex.

With a bound on what fits into a task, graphs of no more edges are contracted there, many to a task,
and larger ones leave the tables once that few edges of theirs are left: a round of tables takes
seconds whatever its size, and the last graph decides on their number.  A task searches a core of
at most CORE edges too; a larger one goes back to the tables.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import held, released

#: Roots of each graph that are searched from at first.
SEEDS = 4
#: Edges of a graph, at most, that a task contracts, and of a core that it searches.
LOCAL, CORE = 200_000, 20_000
EDGE, PLACE = ["graph_id", "u", "v"], ["graph_id", "root", "node"]
BEST = "graph_id string, girth bigint"
PART = "graph_id string, u bigint, v bigint, w bigint, girth bigint"

Weighted = dict[int, dict[int, int]]


def of_rows(u: list[int], v: list[int], w: list[int]) -> Weighted:
    """The neighbours of each vertex with the weights of the edges; no loops, no two edges with the same ends but copies."""
    near: Weighted = defaultdict(dict)
    for a, b, x in zip(u, v, w, strict=True):
        near[a][b] = near[b][a] = x
    return near


def thinned(near: Weighted) -> int | None:
    """Contracts the graph to its core; the shortest cycle met on the way."""
    best, thin = None, [v for v, own in near.items() if len(own) < 3]
    while thin:
        own = near.pop(x := thin.pop(), None)
        if own is None:
            continue
        for y in own:
            del near[y][x]
        if len(own) == 2:
            (a, one), (b, other) = own.items()
            w, rival = one + other, near[a].get(b)
            if rival is not None:
                best = w + rival if best is None else min(best, w + rival)
                w = min(w, rival)
            near[a][b] = near[b][a] = w
        thin += [y for y in own if len(near[y]) < 3]
    return best


def shortest(near: Weighted, best: int | None) -> int | None:
    """The shortest cycle of a core, or ``best`` if none is shorter; takes the graph apart.

    A root goes when its search is done, hubs first, so that no later one looks behind it.
    """
    for root in sorted(near, key=lambda v: (-len(near[v]), v)):
        if best is not None and best <= 3:
            break
        dist, via, done, heap = {root: 0}, {root: root}, set(), [(0, root)]
        while heap:
            d, x = heappop(heap)
            if x in done:
                continue
            if best is not None and 2 * d >= best:
                break
            done.add(x)
            for y, w in near[x].items():
                if y == via[x]:
                    continue
                if y in dist and (best is None or d + w + dist[y] < best):
                    best = d + w + dist[y]
                if y not in dist or d + w < dist[y]:
                    dist[y], via[y] = d + w, x
                    if best is None or 2 * (d + w) < best:
                        heappush(heap, (d + w, y))
        for y in near.pop(root):
            del near[y][root]
    return best


def in_tasks(edges: DataFrame) -> DataFrame:
    """(graph_id, u, v, w, girth): a row with the shortest cycle found in each graph, or null, and rows with the edges of a core of over CORE.

    edges: (graph_id, u, v, w), no more of a graph than fit into a task; copies and loops only of weight 1.
    """
    core_edges = CORE

    def kernel(own: pa.Table) -> pa.Table:
        u, v, w = (own[c].to_numpy() for c in ("u", "v", "w"))
        rows, girth = [], 1
        if (u != v).all():
            near = of_rows(u.tolist(), v.tolist(), w.tolist())
            girth = thinned(near)
            if sum(map(len, near.values())) <= 2 * core_edges:
                girth = shortest(near, girth)
            elif girth is None or girth > 3:
                rows = [(a, b, w) for a, own in near.items() for b, w in own.items() if a < b]
        rows = [(*row, None) for row in rows] + [(None, None, None, girth)]
        numbers = [pa.array(column, pa.int64()) for column in zip(*rows, strict=True)]
        return pa.table([pa.array([own["graph_id"][0].as_py()] * len(rows), pa.string()), *numbers], [*EDGE, "w", "girth"])

    return edges.select(*EDGE, "w").groupBy("graph_id").applyInArrow(kernel, PART)


def arcs(edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst, w) in both directions."""
    ends = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))
    return edges.select("graph_id", "w", F.explode(ends).alias("e")).select("graph_id", "e.src", "e.dst", "w")


def lightest(edges: DataFrame) -> DataFrame:
    """(graph_id, u, v, w, place): of the edges between the same ends the two lightest."""
    order = Window.partitionBy(*EDGE).orderBy("w")
    return edges.select(*EDGE, "w", F.row_number().over(order).alias("place")).filter("place <= 2")


def doubled(edges: DataFrame) -> DataFrame:
    """(graph_id, girth) of the lightest pair of edges with the same ends."""
    both = edges.groupBy(*EDGE).agg(F.sum("w").alias("girth"), F.count("*").alias("n")).filter("n = 2")
    return both.groupBy("graph_id").agg(F.min("girth").alias("girth"))


def sized(edges: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """The edges of the graphs that have at most ``small`` of them, and of the others."""
    large = held(edges.groupBy("graph_id").agg(F.count("*").alias("m")).filter(F.col("m") > small).select("graph_id"), "large")
    if large.isEmpty():
        return edges, edges.limit(0)
    return edges.join(large, "graph_id", "left_anti"), edges.join(large, "graph_id", "left_semi")


def core(edges: DataFrame, small: int = 0) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The core of each graph, (graph_id, u, v, w), and the shortest cycle met on the way, (graph_id, girth).

    edges: (graph_id, u, v) with u < v, each once.  Graphs of which no more than ``small`` edges are
    left by a round leave; the third part has their edges.
    """
    now = held(edges.select(*EDGE, F.lit(1).cast("bigint").alias("w")), "contracted")
    found, left, turn = [], [], 0
    while not now.isEmpty():
        turn += 1
        chance = lambda c: F.xxhash64("graph_id", c, F.lit(turn))  # noqa: B023, E731
        ends = arcs(now)
        own = ends.groupBy("graph_id", "src").agg(F.count("*").alias("degree"), F.min(F.struct("dst", "w")).alias("a"), F.max(F.struct("dst", "w")).alias("b")).filter("degree <= 2")
        thin = held(own, "thin")
        met = thin.select("graph_id", "src", F.explode(F.array("a.dst", "b.dst")).alias("dst"))
        beaten = met.join(thin.select("graph_id", F.col("src").alias("dst")), ["graph_id", "dst"]).filter(F.struct(chance("dst"), "dst") < F.struct(chance("src"), "src"))
        chosen = held(thin.join(beaten.select("graph_id", "src").distinct(), ["graph_id", "src"], "left_anti"), "chosen")
        if chosen.isEmpty():
            released(thin, chosen)
            break
        across = chosen.filter("degree = 2").select("graph_id", F.col("a.dst").alias("u"), F.col("b.dst").alias("v"), (F.col("a.w") + F.col("b.w")).alias("w"))
        rest = now
        for end in ("u", "v"):
            rest = rest.join(chosen.select("graph_id", F.col("src").alias(end)), ["graph_id", end], "left_anti")
        both = held(lightest(rest.select(*EDGE, "w").union(across)), "contracted")
        if turn == 1 or not across.isEmpty():
            found.append(held(doubled(both), "met"))
        released(now, thin, chosen)
        now = held(both.filter("place = 1").drop("place"), "contracted")
        released(both)
        if small:
            few, many = sized(now, small)
            few = held(few, "left")
            if few.isEmpty():
                released(few)
                continue
            left.append(few)
            many = held(many, "contracted")
            released(now)
            now = many
    best = now.sparkSession.createDataFrame([], BEST)
    for rows in found:
        best = best.union(rows)
    return now, best.groupBy("graph_id").agg(F.min("girth").alias("girth")), left


def search(ends: DataFrame, roots: DataFrame, best: DataFrame) -> DataFrame:
    """(graph_id, girth): ``best`` with the shortest cycles through the roots and what comes after them.

    ends: (graph_id, src, dst, w, rank) with the rank of dst; roots: (graph_id, root, rank), where
    vertices of a greater rank may be entered.
    """
    unknown = F.lit(None).cast("bigint")
    known = roots.select("graph_id", "root", "rank", F.col("root").alias("node"), F.lit(0).cast("bigint").alias("dist"), unknown.alias("via"))
    known, fringe = held(known, "known"), None
    while True:
        start = (known if fringe is None else fringe).select("graph_id", "root", F.col("rank").alias("own"), F.col("node").alias("src"), "dist", "via")
        further = start.join(ends, ["graph_id", "src"]).filter("(rank > own or dst = root) and not (dst <=> via)")
        further = further.select("graph_id", "root", F.col("own").alias("rank"), F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), F.col("src").alias("via"), F.lit(1).alias("fresh"))
        further = further.join(best, "graph_id", "left").filter("girth is null or dist < girth").drop("girth")
        rows = further.union(known.select(*further.columns[:-1], F.lit(0)))
        rows = rows.groupBy(*PLACE, "rank", "via").agg(F.min(F.struct("dist", "fresh")).alias("x")).select(*PLACE, "rank", "x.dist", "x.fresh", "via")
        two = held(rows.withColumn("place", F.row_number().over(Window.partitionBy(*PLACE).orderBy("dist", "fresh", "via"))).filter("place <= 2"), "two-paths")
        closed = two.groupBy(*PLACE).agg(F.sum("dist").alias("girth"), F.count("*").alias("n")).filter("n = 2").select("graph_id", "girth")
        best = held(best.union(closed.groupBy("graph_id").agg(F.min("girth").alias("girth"))).groupBy("graph_id").agg(F.min("girth").alias("girth")), "best")
        open_ = two.filter("place = 1").join(best, "graph_id", "left").filter("girth is null or 2 * dist < girth").drop("girth", "place")
        released(known)
        known = held(open_, "known")
        released(two)
        fringe = known.filter("fresh = 1")
        if fringe.isEmpty():
            return best


def triangles(rest: DataFrame, degrees: DataFrame) -> DataFrame:
    """(graph_id, girth) of the graphs with a triangle of edges of weight 1.

    Each has one path from its first through its second to its third vertex, in the order of rising
    degrees.  Where degrees part the two sides of a bipartite graph, no path of two steps rises.
    """
    unit = rest.filter("w = 1").select(*EDGE)
    for end in ("u", "v"):
        unit = unit.join(degrees.select("graph_id", F.col("src").alias(end), F.struct("degree", F.col("src").alias("id")).alias(f"of_{end}")), ["graph_id", end])
    low, high = F.least("of_u", "of_v"), F.greatest("of_u", "of_v")
    rising = held(unit.select("graph_id", low["id"].alias("a"), high["id"].alias("b")), "rising")
    onward = rising.select("graph_id", F.col("a").alias("b"), F.col("b").alias("c"))
    ends = rising.select("graph_id", "a", F.col("b").alias("c"))
    found = rising.join(onward, ["graph_id", "b"]).join(ends, ["graph_id", "a", "c"], "left_semi")
    out = held(found.select("graph_id").distinct().withColumn("girth", F.lit(3).cast("bigint")), "triangles")
    released(rising)
    return out


def girths(edges: DataFrame, small: int = 0) -> DataFrame:
    """(graph_id, girth) of the graphs that have a cycle; a loop is a cycle of one edge.

    small: graphs of at most so many edges, as they are or after a round, are contracted in a task each.
    """
    own = edges.filter("graph_id is not null").select("graph_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    fitting = []
    if small:
        few, own = sized(held(own, "own"), small)
        fitting.append(few.withColumn("w", F.lit(1).cast("bigint")))
    own = own.distinct()
    loops = own.filter("u = v").select("graph_id", F.lit(1).cast("bigint").alias("girth")).distinct()
    rest, best, left = core(own.filter("u < v").join(loops, "graph_id", "left_anti"), small)
    if small:
        parts = held(in_tasks(reduce(DataFrame.union, fitting + left)), "parts")
        rest = rest.union(parts.filter("u is not null").drop("girth"))
        best = best.union(parts.filter("girth is not null").select("graph_id", "girth")).groupBy("graph_id").agg(F.min("girth").alias("girth"))
        released(*left)
    best = held(best, "best")
    if not rest.isEmpty():
        rest = held(rest.join(best, "graph_id", "left").filter("girth is null or w < girth").drop("girth"), "core")
        degrees = held(arcs(rest).groupBy("graph_id", "src").agg(F.count("*").alias("degree")), "degrees")
        rank = F.struct((-F.col("degree")).alias("falling"), F.col("src").alias("id"))
        ends = held(arcs(rest).join(degrees.select("graph_id", F.col("src").alias("dst"), rank.alias("rank")), ["graph_id", "dst"]).select("graph_id", "src", "dst", "w", "rank"), "arcs")
        by_degree = Window.partitionBy("graph_id").orderBy(rank)
        lowest = F.struct(F.lit(-(1 << 62)).alias("falling"), F.lit(0).cast("bigint").alias("id"))
        seeds = degrees.withColumn("place", F.row_number().over(by_degree)).filter(F.col("place") <= SEEDS).select("graph_id", F.col("src").alias("root"), lowest.alias("rank"))
        best = search(ends, seeds, best)
        four = held(best.filter("girth = 4").select("graph_id"), "four")
        if not four.isEmpty():
            best = best.union(triangles(rest.join(four, "graph_id", "left_semi"), degrees))
            best = held(best.groupBy("graph_id").agg(F.min("girth").alias("girth")), "best")
        settled = best.filter("girth <= 4").select("graph_id")
        every = degrees.select("graph_id", F.col("src").alias("root"), rank.alias("rank"))
        best = search(ends, every.join(settled, "graph_id", "left_anti"), best)
        released(degrees, ends, rest, four)
    return loops.union(best).select("graph_id", F.col("girth").cast("int").alias("girth"))
