"""One row of figures for each graph, and whether it is what a search looks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringspark.functions.bounds import moore_column

from .cycles import girth
from .metrics import counts, degrees


def figures(vertices: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(graph_id, k, g, n, m, share, low, high, regular, girth, mb); targets: (graph_id, k, g)."""
    per_node = degrees(vertices, edges).join(targets, "graph_id")
    by = per_node.groupBy("graph_id").agg(
        F.avg((F.col("degree") == F.col("k")).cast("double")).alias("share"),
        F.count_if(F.col("degree") < F.col("k")).alias("low"),
        F.count_if(F.col("degree") > F.col("k")).alias("high"),
        F.bool_and(F.col("degree") == F.col("k")).alias("regular"),
    )
    mb = moore_column(F.col("k"), F.col("g")).alias("mb")
    rows = targets.join(counts(vertices, edges), "graph_id", "left").join(by, "graph_id", "left").join(girth(vertices, edges), "graph_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("graph_id", "k", "g", zero("num_nodes").alias("n"), zero("num_edges").alias("m"), F.coalesce("share", F.lit(0.0)).alias("share"), zero("low").alias("low"), zero("high").alias("high"), F.coalesce("regular", F.lit(True)).alias("regular"), "girth", mb)


def is_goal(regular: Column, cycle: Column, g: Column) -> Column:
    return regular & F.coalesce(cycle == g, F.lit(False))


def validate(vertices: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """The validation record of each graph: a cage is k-regular of girth g, optimal at the bound."""
    valid = is_goal(F.col("regular"), F.col("girth"), F.col("g"))
    return figures(vertices, edges, targets).select(
        "graph_id", "k", "g", F.col("n").alias("num_nodes"), F.col("m").alias("num_edges"), "girth", F.col("regular").alias("is_k_regular"),
        valid.alias("is_valid_cage"), F.col("mb").alias("moore_bound"), (valid & (F.col("n") == F.col("mb"))).alias("is_optimal"),
    )
