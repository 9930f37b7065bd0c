"""Degrees, counts and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .indexes import dense, smallest_free

KEY = ["graph_id", "node_id"]


def adjacency(edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst) in both directions; a self-loop comes twice."""
    ends = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))
    return edges.select("graph_id", F.explode(ends).alias("e")).select("graph_id", "e.src", "e.dst")


def counted(vertices: DataFrame, per_node: DataFrame, column: str) -> DataFrame:
    found = vertices.select(*KEY).join(per_node, KEY, "left")
    return found.select(*KEY, F.coalesce(column, F.lit(0)).cast("bigint").alias(column))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, degree); a self-loop counts two."""
    own = adjacency(edges).groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))
    return counted(vertices, own, "degree")


def neighbor_counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, neighbors): different neighbours, oneself included by a self-loop."""
    own = adjacency(edges).distinct().groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count("*").alias("neighbors"))
    return counted(vertices, own, "neighbors")


def neighbor_lists(edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, neighbors) with a sorted array."""
    return adjacency(edges).groupBy("graph_id", F.col("src").alias("node_id")).agg(F.sort_array(F.collect_set("dst")).alias("neighbors"))


def counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, num_nodes, num_edges)."""
    rows = vertices.select("graph_id", F.lit(1).alias("n"), F.lit(0).alias("m")).union(edges.select("graph_id", F.lit(0), F.lit(1)))
    return rows.groupBy("graph_id").agg(F.sum("n").cast("bigint").alias("num_nodes"), F.sum("m").cast("bigint").alias("num_edges"))


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("u = v")


def isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices without any edge."""
    return vertices.select(*KEY).join(adjacency(edges).select("graph_id", F.col("src").alias("node_id")), KEY, "left_anti")


def regularity(vertices: DataFrame, edges: DataFrame, k: int | None = None) -> DataFrame:
    """(graph_id, min_degree, max_degree, is_regular): for a given k, whether all degrees are k."""
    own = degrees(vertices, edges).groupBy("graph_id").agg(F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"))
    same = F.col("min_degree") == F.col("max_degree")
    return own.withColumn("is_regular", same if k is None else same & (F.col("min_degree") == k))


def regular_share(vertices: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    return degrees(vertices, edges).groupBy("graph_id").agg(F.avg((F.col("degree") == k).cast("double")).alias("share"))


def degree_partition(vertices: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(graph_id, node_id, side): below, at or above degree k."""
    side = F.element_at(F.array(F.lit("below"), F.lit("at"), F.lit("above")), F.signum(F.col("degree") - k).cast("int") + 2)
    return degrees(vertices, edges).select(*KEY, side.alias("side"))


def edge_deficit(vertices: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Edges that a k-regular graph of this order has over the present ones."""
    return counts(vertices, edges).select("graph_id", (F.expr(f"num_nodes * {k} div 2") - F.col("num_edges")).alias("deficit"))


def next_ids(vertices: DataFrame) -> DataFrame:
    """(graph_id, after_max, count, smallest_free): the three rules for a new vertex's id."""
    free = smallest_free(vertices)
    own = vertices.groupBy("graph_id").agg((F.coalesce(F.max("node_id"), F.lit(-1)) + 1).alias("after_max"), F.count_distinct("node_id").alias("num_nodes"))
    return own.join(free, "graph_id", "left").select("graph_id", "after_max", "num_nodes", F.coalesce("free", F.lit(0)).alias("smallest_free"))


def dense_index(vertices: DataFrame) -> DataFrame:
    """(graph_id, node_id, idx, norm): place among the sorted ids, and that over n - 1."""
    return dense(vertices).select(*KEY, "idx", (F.col("idx") / F.greatest(F.col("n") - 1, F.lit(1))).alias("norm"))


def indexed_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, u, v, u_idx, v_idx): edges with their ends' places among the sorted ids."""
    own = dense_index(vertices).select(*KEY, "idx")
    out = edges.select("graph_id", "u", "v")
    for end in "uv":
        out = out.join(own.select("graph_id", F.col("node_id").alias(end), F.col("idx").alias(f"{end}_idx")), ["graph_id", end])
    return out.select("graph_id", "u", "v", "u_idx", "v_idx")


def require(vertices: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` rows; a vertex that does not exist fails the query."""
    found = wanted.join(vertices.select(*KEY, F.lit(True).alias("there")), KEY, "left")
    missing = F.raise_error(F.concat(F.lit("no such vertex: "), F.col("node_id").cast("string"))).cast("bigint")
    return found.withColumn("node_id", F.when(F.col("there"), F.col("node_id")).otherwise(missing)).drop("there")
