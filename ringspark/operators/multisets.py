"""Fingerprints of graphs as sums of hashes: no list of edges or labels is ever brought together.

Two sums of 60 bits each, of the first and the next 15 digits of md5 texts, wrap around at 2^60.
A sum does not depend on the order of what it adds up, is partly done before the shuffle, and an
edge that comes or goes is added or taken away: the fingerprint of an edited graph follows from
that of the graph and the edits alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import KEY, adjacency, degrees

WRAP = 1 << 60
EDGE, SUMS = ["graph_id", "u", "v"], ("a", "b")


def hashes(text: Column) -> dict[str, Column]:
    """The two numbers of a text."""
    digits = F.md5(text)
    return {x: F.conv(F.substring(digits, at, 15), 16, 10).cast("bigint") for x, at in zip(SUMS, (1, 16), strict=True)}


def wrapped(total: Column) -> Column:
    return F.pmod(total, F.lit(WRAP).cast("decimal(38,0)")).cast("bigint")


def sums(rows: DataFrame, keys: list[str], text: Column, sign: Column | None = None) -> DataFrame:
    """(keys, a, b): sums of the numbers of a text for each key; sign: 1 or -1."""
    each = {x: c.cast("decimal(20,0)") * (F.lit(1) if sign is None else sign) for x, c in hashes(text).items()}
    return rows.groupBy(*keys).agg(*(wrapped(F.sum(c)).alias(x) for x, c in each.items()))


def edge_text(u: str = "u", v: str = "v") -> Column:
    return F.concat_ws("-", F.col(u).cast("string"), F.col(v).cast("string"))


def of_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, a, b): equal for graphs with the same edges, a graph without edges has zeros."""
    zero = F.lit(0).cast("bigint")
    found = sums(edges.select(*EDGE), ["graph_id"], edge_text())
    return vertices.select("graph_id").distinct().join(found, "graph_id", "left").select("graph_id", *(F.coalesce(x, zero).alias(x) for x in SUMS))


def edited(prints: DataFrame, edges: DataFrame, edits: DataFrame) -> DataFrame:
    """(graph_id, state, a, b) of each graph after the edits of a state, which toggle edges.

    edits: (graph_id, state, u, v) with u <= v, each at most once in a state.  Only the edits are
    looked up among the edges; no edited graph is built.
    """
    there = edges.select(*EDGE, F.lit(True).alias("there"))
    signed = edits.select("graph_id", "state", "u", "v").join(there, EDGE, "left")
    change = sums(signed, ["graph_id", "state"], edge_text(), F.when(F.col("there"), -1).otherwise(1))
    base = prints.select("graph_id", *(F.col(x).alias(f"own_{x}") for x in SUMS))
    both = change.join(base, "graph_id")
    return both.select("graph_id", "state", *(F.pmod(F.col(x) + F.col(f"own_{x}"), F.lit(WRAP)).alias(x) for x in SUMS))


def named(rows: DataFrame) -> DataFrame:
    """The rows with their two sums as one text, ``fingerprint``."""
    return rows.select(*(c for c in rows.columns if c not in SUMS), F.concat_ws("-", *(F.col(x).cast("string") for x in SUMS)).alias("fingerprint"))


def refined(vertices: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(graph_id, a, b): equal for graphs that label refinement does not tell apart.

    A vertex starts with its degree; a round hashes its label with the sums of its neighbours'
    labels, so a hub costs a sum and not a list.
    """
    labels = degrees(vertices, edges).select(*KEY, F.col("degree").cast("string").alias("label"))
    steps = adjacency(edges)
    for _ in range(rounds):
        near = sums(steps.join(labels.select("graph_id", F.col("node_id").alias("dst"), "label"), ["graph_id", "dst"]), ["graph_id", "src"], F.col("label")).withColumnRenamed("src", "node_id")
        text = F.concat_ws(":", "label", *(F.coalesce(x, F.lit(0)).cast("string") for x in SUMS))
        labels = labels.join(near, KEY, "left").select(*KEY, F.md5(text).alias("label"))
    return sums(labels, ["graph_id"], F.col("label"))
