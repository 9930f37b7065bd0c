"""Edge-list texts of graphs that do not fit into a task: lines by place, written in parts.

A line's place in its graph's text comes from range-sorted prefix sums of line lengths, so no task
sees a whole graph.  The text is written as files of consecutive lines, with a manifest of where
each part starts; put end to end in that order they are the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringspark.operators.indexes import dealt, numbered
from ringspark.operators.lineage import held

ORDER = ["s", "u", "v"]
MANIFEST = "_manifest"


def lines(vertices: DataFrame, edges: DataFrame, isolated_first: bool = True) -> DataFrame:
    """(graph_id, s, u, v, line): vertices without edges by id, edges by (u, v), in sections s."""
    touched = edges.select("graph_id", F.col("u").alias("node_id")).union(edges.select("graph_id", "v")).distinct()
    alone = vertices.select("graph_id", "node_id").distinct().join(touched, ["graph_id", "node_id"], "left_anti")
    section = 0 if isolated_first else 2
    rows = alone.select("graph_id", F.lit(section).alias("s"), F.col("node_id").alias("u"), F.col("node_id").alias("v"), F.col("node_id").cast("string").alias("line"))
    return rows.union(edges.select("graph_id", F.lit(1), "u", "v", F.concat_ws(" ", F.col("u").cast("string"), F.col("v").cast("string"))))


def placed(vertices: DataFrame, edges: DataFrame, isolated_first: bool = True, ranges: int | None = None) -> DataFrame:
    """(graph_id, start, line): every line with the byte where it starts in the text of its graph."""
    sized = lines(vertices, edges, isolated_first).withColumn("size", F.octet_length("line") + 1)
    return numbered(sized, ["graph_id"], ORDER, "start", weight="size", ranges=ranges).select("graph_id", "start", "line")


def write(vertices: DataFrame, edges: DataFrame, path: str, isolated_first: bool = True, parts: int | None = None) -> DataFrame:
    """Write the texts under ``path`` and return the manifest (graph_id, part, start, bytes, lines).

    Each part of a graph is one file of consecutive lines.  The manifest is written last: a folder
    without one is not finished.
    """
    rows = dealt(placed(vertices, edges, isolated_first, parts), ["graph_id"], ["start"], "part", parts)
    sorted_ = rows.repartition("graph_id", "part").sortWithinPartitions("graph_id", "part", "start")
    sorted_.select("graph_id", "part", "line").write.partitionBy("graph_id", "part").mode("error").text(path)
    manifest = rows.groupBy("graph_id", "part").agg(F.min("start").alias("start"), F.sum(F.octet_length("line") + 1).cast("bigint").alias("bytes"), F.count("*").alias("lines"))
    manifest = held(manifest, "manifest")
    manifest.write.parquet(f"{path}/{MANIFEST}")
    return manifest


def read(spark: SparkSession, path: str) -> DataFrame:
    """(graph_id, part, line) of the files that a manifest names; without one it fails."""
    known = spark.read.parquet(f"{path}/{MANIFEST}").select("graph_id", "part")
    return spark.read.schema("line string, graph_id string, part int").text(path).join(known, ["graph_id", "part"], "left_semi")
