"""Edits: each returns new tables, the given ones stay as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringspark.functions.basic import uniform

from .metrics import KEY, adjacency, degrees, next_ids

EDGE = ["graph_id", "u", "v"]


def canonical_edges(pairs: DataFrame) -> DataFrame:
    """Distinct edges with u <= v of rows (graph_id, u, v) in any order."""
    return pairs.select("graph_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def toggle(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges in exactly one of the two tables, found in one aggregation."""
    rows = edges.select(*EDGE, F.lit(1).alias("a"), F.lit(0).alias("b")).union(pairs.select(*EDGE, F.lit(0), F.lit(1)))
    return rows.groupBy(*EDGE).agg(F.max("a").alias("a"), F.max("b").alias("b")).filter("a <> b").select(*EDGE)


def add_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    return canonical_edges(edges.select(*EDGE).union(pairs.select(*EDGE)))


def remove_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    return edges.join(canonical_edges(pairs), EDGE, "left_anti")


def add_vertex(vertices: DataFrame, rule: str = "after_max") -> DataFrame:
    """A new vertex for each graph; rule: after_max, num_nodes or smallest_free."""
    return vertices.select(*KEY).union(next_ids(vertices).select("graph_id", F.col(rule)))


def remove_vertices(vertices: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the vertices (graph_id, node_id) in ``gone`` and their edges."""
    kept = edges
    for end in ("u", "v"):
        kept = kept.join(gone.select("graph_id", F.col("node_id").alias(end)), ["graph_id", end], "left_anti")
    return vertices.join(gone.select(*KEY), KEY, "left_anti"), kept.select(*EDGE)


def placed(rows: DataFrame, columns: list[str], seed: int, most: int) -> DataFrame:
    """Up to ``most`` rows of each graph with their place in the order of an md5 uniform of the row.

    Spark limits each task's rows of a graph before the shuffle, so no graph is in one task whole.
    """
    draw = uniform(F.lit(seed), F.col("graph_id"), *(F.col(c) for c in columns))
    order = Window.partitionBy("graph_id").orderBy(draw, *columns)
    return rows.select("graph_id", *columns, F.row_number().over(order).alias("place")).filter(F.col("place") <= most)


def one_each(rows: DataFrame, columns: list[str], seed: int = 0, most: int = 1) -> DataFrame:
    """Up to ``most`` rows of each graph, drawn by an md5 uniform of the row."""
    return placed(rows, columns, seed, most).drop("place")


def remove_random_edge(edges: DataFrame, seed: int = 0) -> DataFrame:
    return remove_edges(edges, one_each(edges, ["u", "v"], seed))


def remove_edge_above(vertices: DataFrame, edges: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Without one edge of a vertex of degree over k: first the vertex is drawn, then its edge."""
    full = one_each(degrees(vertices, edges).filter(F.col("degree") > k), ["node_id"], seed)
    at = adjacency(edges).join(full.select("graph_id", F.col("node_id").alias("src")), ["graph_id", "src"], "left_semi").distinct()
    return remove_edges(edges, one_each(at, ["src", "dst"], seed).select("graph_id", F.col("src").alias("u"), F.col("dst").alias("v")))


def remove_random_vertex(vertices: DataFrame, edges: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Without one vertex of each graph: one of degree at most 1 if there is any."""
    own = degrees(vertices, edges).select("graph_id", (F.col("degree") > 1).cast("int").alias("busy"), "node_id")
    least = own.groupBy("graph_id").agg(F.min("busy").alias("busy"))
    return remove_vertices(vertices, edges, one_each(own.join(least, ["graph_id", "busy"]), ["node_id"], seed))


def place_vertex(positions: DataFrame, x: float, y: float) -> DataFrame:
    """Positions with a new vertex of each graph at a point; its id is the smallest free one."""
    new = next_ids(positions).select("graph_id", F.col("smallest_free").alias("node_id"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(False).alias("fixed"))
    return positions.select(*new.columns).union(new)


def clear_predictions(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows with these columns empty."""
    return rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in columns})


def clear(vertices: DataFrame, edges: DataFrame, graph_ids: list[str]) -> tuple[DataFrame, DataFrame]:
    gone = F.col("graph_id").isin(graph_ids)
    return vertices.filter(~gone), edges.filter(~gone)
