"""Structural fingerprints and what is built on them: states seen before, the best next ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import KEY, adjacency, degrees


def refined(vertices: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(graph_id, node_id, label) after rounds of hashing in the sorted labels of neighbours."""
    labels = degrees(vertices, edges).select(*KEY, F.col("degree").cast("string").alias("label"))
    steps = adjacency(edges)
    for _ in range(rounds):
        near = steps.join(labels.select("graph_id", F.col("node_id").alias("dst"), "label"), ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("node_id")).agg(F.array_join(F.sort_array(F.collect_list("label")), "").alias("near"))
        labels = labels.join(near, KEY, "left").select(*KEY, F.md5(F.concat("label", F.coalesce("near", F.lit("")))).alias("label"))
    return labels


def wl_hash(vertices: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(graph_id, fingerprint): equal for graphs that refinement does not tell apart."""
    return refined(vertices, edges, rounds).groupBy("graph_id").agg(F.md5(F.array_join(F.sort_array(F.collect_list("label")), "")).alias("fingerprint"))


def edge_hash(edges: DataFrame) -> DataFrame:
    """(graph_id, fingerprint) of the sorted edges: equal only for equal edge sets."""
    rows = F.transform(F.array_sort(F.collect_set(F.struct("u", "v"))), lambda e: F.concat_ws("-", e["u"].cast("string"), e["v"].cast("string")))
    return edges.groupBy("graph_id").agg(F.md5(F.array_join(rows, ",")).alias("fingerprint"))


def unseen(states: DataFrame, visited: DataFrame) -> DataFrame:
    """The first state of each fingerprint that was not visited; states: (graph_id, fingerprint)."""
    fresh = states.join(visited.select("fingerprint"), "fingerprint", "left_anti")
    return fresh.groupBy("fingerprint").agg(F.min("graph_id").alias("graph_id"))


def best(frontier: DataFrame, k: int = 1) -> DataFrame:
    """The k best of the whole frontier by score, then by who came first."""
    return frontier.orderBy(F.desc("score"), "counter").limit(k)


def ranked(frontier: DataFrame, key: str = "session") -> DataFrame:
    """Each session's states with their place in the order of expansion."""
    return frontier.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "counter")))


def insert(visited: DataFrame, states: DataFrame) -> DataFrame:
    """The visited fingerprints with those of new states, each once."""
    return visited.select("fingerprint").union(states.select("fingerprint")).distinct()
