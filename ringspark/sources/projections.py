"""Graphs as projections of relational tables.

Each returns (vertices, edges).  Columns are picked at the scan, so only those few are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringspark.functions.basic import uniform

Graphs = tuple[DataFrame, DataFrame]
SUPPLIER, NATION, CUSTOMER = 1_000_000_000, 1_000, 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oriented(df: DataFrame, graph, a, b) -> DataFrame:
    """Distinct edges with u <= v."""
    return df.select(graph.alias("graph_id"), F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def hand_off(spark: SparkSession, sf_dir: str, span: str = "yyyy-MM-dd") -> Graphs:
    """One graph for each day (or other span): users active then, linked when one follows the other."""
    events = read(spark, sf_dir, "events").select(F.date_format("ts", span).alias("day"), "ts", "event_id", "user_id")
    after = F.lead("user_id").over(Window.partitionBy("day").orderBy("ts", "event_id"))
    pairs = events.select("day", "user_id", after.alias("next")).filter("next is not null")
    return events.select(F.col("day").alias("graph_id"), F.col("user_id").alias("node_id")).distinct(), oriented(pairs, F.col("day"), F.col("user_id"), F.col("next"))


def hours(spark: SparkSession, sf_dir: str) -> Graphs:
    """As :func:`hand_off` for each hour: many sparse graphs, with trees, rings and cycles of many lengths."""
    return hand_off(spark, sf_dir, "yyyy-MM-dd HH")


def supply(spark: SparkSession, sf_dir: str) -> Graphs:
    """Parts and suppliers, linked by line items."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"))
    suppliers = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + SUPPLIER).alias("node_id"))
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_suppkey") + SUPPLIER).alias("s"))
    return parts.union(suppliers).select(F.lit("supply").alias("graph_id"), "node_id"), oriented(lines, F.lit("supply"), F.col("l_partkey"), F.col("s"))


def trade(spark: SparkSession, sf_dir: str) -> Graphs:
    """Nations, linked when a customer of one buys from a supplier of the other."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    buyers = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    sellers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    pairs = lines.join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
    nations = read(spark, sf_dir, "nation").select(F.lit("trade").alias("graph_id"), F.col("n_nationkey").cast("bigint").alias("node_id"))
    return nations, oriented(pairs, F.lit("trade"), F.col("c_nationkey").cast("bigint"), F.col("s_nationkey").cast("bigint"))


def forest(spark: SparkSession, sf_dir: str) -> Graphs:
    """Regions, their nations and these nations' customers: no cycle."""
    nations = read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("bigint").alias("u"), (F.col("n_nationkey") + NATION).cast("bigint").alias("v"))
    customers = read(spark, sf_dir, "customer").select((F.col("c_nationkey") + NATION).cast("bigint").alias("u"), (F.col("c_custkey") + CUSTOMER).cast("bigint").alias("v"))
    regions = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("v"))
    ids = regions.union(nations.select("v")).union(customers.select("v"))
    return ids.select(F.lit("forest").alias("graph_id"), F.col("v").alias("node_id")), nations.union(customers).select(F.lit("forest").alias("graph_id"), "u", "v")


def random_graphs(graphs: DataFrame, min_nodes: int = 5, max_nodes: int = 12, min_prob: float = 0.15, max_prob: float = 0.60, self_loop_prob: float = 0.1, seed: int = 0) -> Graphs:
    """For each row (id) a graph draws its order and edge probability, then every pair and loop on its own.

    Draws are md5 uniforms of (seed, graph, what), so every engine and every run has the same.
    """
    if min_nodes > max_nodes or min_prob > max_prob:
        raise ValueError("a minimum is over its maximum")
    draw = lambda *parts: uniform(F.lit(seed), *parts)
    ids = graphs.select(F.col("id"), (min_nodes + F.floor(draw(F.col("id"), F.lit("n")) * (max_nodes - min_nodes + 1))).alias("n"), (min_prob + draw(F.col("id"), F.lit("p")) * (max_prob - min_prob)).alias("p"))
    name = F.concat(F.lit("r"), F.col("id").cast("string"))
    nodes = ids.select(name.alias("graph_id"), "id", "n", "p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("u"))
    pairs = nodes.select("graph_id", "id", "p", "u", F.explode(F.sequence(F.col("u"), F.col("n") - 1)).alias("v"))
    chance = F.when(F.col("u") == F.col("v"), F.lit(self_loop_prob)).otherwise(F.col("p"))
    return nodes.select("graph_id", F.col("u").alias("node_id")), pairs.filter(draw(F.col("id"), F.col("u"), F.col("v")) < chance).select("graph_id", "u", "v")


def gold_rows() -> tuple[list[tuple[str, int]], list[tuple[str, int, int]]]:
    """Named graphs with known girth."""
    edges = {
        "petersen": [e for i in range(5) for e in ((i, (i + 1) % 5), (i, i + 5), (5 + i, 5 + (i + 2) % 5))],
        "heawood": [e for i in range(14) for e in [(i, (i + 1) % 14)] + [(i, (i + 5) % 14)] * (i % 2 == 0)],
        "c8": [(i, (i + 1) % 8) for i in range(8)],
        "k4": [(i, j) for i in range(4) for j in range(i + 1, 4)],
        "path": [(0, 1), (1, 2)],
        "loop": [(0, 0)],
    }
    rows = [(g, min(e), max(e)) for g, own in edges.items() for e in own]
    return sorted({(g, x) for g, *e in rows for x in e}), sorted(rows)


def gold(spark: SparkSession) -> Graphs:
    nodes, edges = gold_rows()
    return spark.createDataFrame(nodes, "graph_id string, node_id bigint"), spark.createDataFrame(edges, "graph_id string, u bigint, v bigint")


def edgeless(orders: DataFrame) -> Graphs:
    """For each row (graph_id, n) n vertices and no edge; n = 0 is the empty graph."""
    nodes = orders.filter("n > 0").select("graph_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint") - 1)).alias("node_id"))
    return nodes, nodes.select("graph_id", F.col("node_id").alias("u"), F.col("node_id").alias("v")).limit(0)
