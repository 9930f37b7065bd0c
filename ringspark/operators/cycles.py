"""Shortest cycles.

Small graphs go through one Python search each, many graphs to a task.  Graphs over a bound are
contracted and searched as tables, see :mod:`.contraction`; both give the same girths.
"""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import contraction
from .lineage import held

SMALL = 20_000


def pruned(neighbors: dict[int, set[int]]) -> dict[int, set[int]]:
    """The graph without hanging trees."""
    left = {v: set(own) for v, own in neighbors.items()}
    leaves = [v for v, own in left.items() if len(own) < 2]
    while leaves:
        x = leaves.pop()
        for y in left.pop(x):
            own = left[y]
            own.discard(x)
            if len(own) == 1:
                leaves.append(y)
    return {v: own for v, own in left.items() if own}


def roots(neighbors: dict[int, set[int]]) -> list[int]:
    """Vertices of a pruned graph of which every cycle has one: forks, and one of each plain ring."""
    out = [v for v, own in neighbors.items() if len(own) > 2]
    seen = set(out)
    for v in neighbors:
        if v in seen:
            continue
        path, ring = [v], True
        seen.add(v)
        while path:
            for y in neighbors[path.pop()]:
                ring &= len(neighbors[y]) == 2
                if y not in seen:
                    seen.add(y)
                    path.append(y)
        if ring:
            out.append(v)
    return out


def shortest_cycle(neighbors: dict[int, set[int]]) -> int | None:
    """Length of a shortest cycle; a self-loop is a cycle of length 1; None without cycles."""
    if any(v in own for v, own in neighbors.items()):
        return 1
    neighbors, best = pruned(neighbors), None
    for root in roots(neighbors):
        depth, parent, queue = {root: 0}, {root: root}, deque([root])
        while queue:
            x = queue.popleft()
            if best is not None and 2 * depth[x] + 1 >= best:
                break
            for y in neighbors[x]:
                if y not in depth:
                    depth[y], parent[y] = depth[x] + 1, x
                    queue.append(y)
                elif parent[x] != y:
                    length = depth[x] + depth[y] + 1
                    best = length if best is None else min(best, length)
    return best


def of_edges(u: list[int], v: list[int]) -> dict[int, set[int]]:
    out: dict[int, set[int]] = defaultdict(set)
    for a, b in zip(u, v, strict=True):
        out[a].add(b)
        out[b].add(a)
    return out


def by_search(edges: DataFrame) -> DataFrame:
    """(graph_id, girth) of every graph that has edges, by one Python search for each."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        length = shortest_cycle(of_edges(pdf["u"].tolist(), pdf["v"].tolist()))
        return pd.DataFrame({"graph_id": pdf["graph_id"].iloc[:1], "girth": pd.array([length], dtype="Int32")})

    return edges.select("graph_id", "u", "v").groupBy("graph_id").applyInPandas(kernel, "graph_id string, girth int")


def girth(vertices: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(graph_id, girth) of every graph; null where there is no cycle."""
    sizes = held(edges.groupBy("graph_id").agg(F.count("*").alias("m")), "sizes")
    large = sizes.filter(F.col("m") > small).select("graph_id")
    found = by_search(edges.join(large, "graph_id", "left_anti"))
    if not large.isEmpty():
        found = found.union(contraction.girths(edges.join(large, "graph_id", "left_semi"), small and contraction.LOCAL))
    return vertices.select("graph_id").distinct().join(found, "graph_id", "left")
