"""Edge-list texts and JSON documents, in and out.

An edge list has a line for each edge ("a b") and for each vertex without edges ("a").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringspark.functions.basic import lenient_int, strict_int, strip
from ringspark.schema import MODEL_INFO, RANDOM_GRAPH


def lines(texts: DataFrame) -> DataFrame:
    """(graph_id, line, parts) of the lines that are not blank; numbers start at 1."""
    split = texts.select("graph_id", F.posexplode(F.split(strip(F.col("text")), "\n")).alias("at", "raw"))
    return split.select("graph_id", (F.col("at") + 1).alias("line"), strip(F.col("raw")).alias("raw")).filter("length(raw) > 0").select("graph_id", "line", "raw", F.split("raw", r"\s+").alias("parts"))


def part(i: int) -> Column:
    return F.try_element_at("parts", F.lit(i))


def both(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of rows (graph_id, a, b); b is null for a vertex alone."""
    vertices = rows.select("graph_id", F.col("a").alias("node_id")).union(rows.filter("b is not null").select("graph_id", "b")).distinct()
    edges = rows.filter("b is not null").select("graph_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    return vertices, edges


def errors(texts: DataFrame) -> DataFrame:
    """(graph_id, line, message) of lines that the strict form does not allow."""
    size = F.size("parts")
    message = F.when(size > 2, "expected one or two numbers").when(strict_int(part(1)).isNull() | ((size == 2) & strict_int(part(2)).isNull()), "not a whole number")
    return lines(texts).select("graph_id", "line", message.alias("message")).filter("message is not null")


def parse(texts: DataFrame, mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of rows (graph_id, text).

    strict: a line that is not one or two whole numbers fails the query, with its number.
    permissive: numbers are taken from the start of the first two tokens, the rest is dropped.
    """
    if mode == "strict":
        bad = (F.size("parts") > 2) | strict_int(part(1)).isNull() | ((F.size("parts") == 2) & strict_int(part(2)).isNull())
        message = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), F.col("raw"))
        first = F.when(bad, F.raise_error(message).cast("bigint")).otherwise(strict_int(part(1)))
        return both(lines(texts).select("graph_id", first.alias("a"), strict_int(part(2)).alias("b")))
    if mode != "permissive":
        raise ValueError("mode is strict or permissive")
    rows = lines(texts).select("graph_id", lenient_int(part(1)).alias("a"), lenient_int(part(2)).alias("b"), F.size("parts").alias("size"))
    return both(rows.filter("a is not null and (size < 2 or b is not null)"))


def parse_json(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of rows (graph_id, text) with JSON lists of lists; other lengths are skipped."""
    rows = texts.select("graph_id", F.explode(F.from_json("text", "array<array<bigint>>")).alias("x")).filter("size(x) in (1, 2) and x[0] is not null")
    return both(rows.select("graph_id", F.col("x")[0].alias("a"), F.try_element_at("x", F.lit(2)).alias("b")))


def requests(rows: DataFrame, schema: str, required: list[str], column: str = "body") -> DataFrame:
    """Documents of a JSON column; one that lacks a required key fails the query with its name."""
    parsed = rows.withColumn("doc", F.from_json(column, schema))
    for key in required:
        parsed = parsed.withColumn("doc", F.when(F.col(f"doc.{key}").isNull(), F.raise_error(F.lit(f"missing: {key}")).cast(parsed.schema["doc"].dataType)).otherwise(F.col("doc")))
    return parsed.drop(column).select("*", "doc.*").drop("doc")


def print_lines(vertices: DataFrame, edges: DataFrame, isolated_first: bool = True) -> DataFrame:
    """(graph_id, text): vertices without edges by id, and edges by (u, v)."""
    touched = edges.select("graph_id", F.col("u").alias("node_id")).union(edges.select("graph_id", "v")).distinct()
    alone = vertices.select("graph_id", "node_id").distinct().join(touched, ["graph_id", "node_id"], "left_anti")
    section = 0 if isolated_first else 2
    rows = alone.select("graph_id", F.lit(section).alias("s"), F.col("node_id").alias("u"), F.col("node_id").alias("v"), F.col("node_id").cast("string").alias("line"))
    rows = rows.union(edges.select("graph_id", F.lit(1), "u", "v", F.concat_ws(" ", F.col("u").cast("string"), F.col("v").cast("string"))))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("s", "u", "v", "line"))), lambda x: x["line"])
    return rows.groupBy("graph_id").agg(F.array_join(ordered, "\n").alias("text"))


def canonical(texts: DataFrame) -> DataFrame:
    """Permissive parse and canonical print."""
    return print_lines(*parse(texts, "permissive"))


def to_json(rows: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """One document for each key: {name: [rows in order]}."""
    fields = [order, *(c for c in rows.columns if c not in (key, order))]
    return rows.groupBy(key).agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))).alias("document"))


def read_model_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL_INFO).json(path, multiLine=True)


def write_model_info(info: DataFrame, path: str) -> None:
    """One document, errors rounded to four digits and the accuracy to two."""
    digits = {"mean_squared_error": 4, "mean_absolute_error": 4, "accuracy": 2}
    rounded = info.withColumn("metrics", F.struct(*(F.bround(f"metrics.{c}", n).alias(c) for c, n in digits.items())))
    rounded.coalesce(1).write.mode("overwrite").json(path)


def with_defaults(rows: DataFrame) -> DataFrame:
    """Requests for random graphs with the defaults where a parameter is missing."""
    names = {"min_nodes": "minNodes", "max_nodes": "maxNodes", "min_prob": "minProb", "max_prob": "maxProb"}
    rest = [c for c in rows.columns if c not in (*names.values(), "allowSelfLoops")]
    return rows.select(*rest, *(F.coalesce(asked, F.lit(RANDOM_GRAPH[name])).alias(name) for name, asked in names.items()), F.coalesce("allowSelfLoops", F.lit(True)).alias("loops"))


def matched(texts: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges of the lines both of whose numbers are vertices there are; other lines are dropped."""
    found = parse(texts, "permissive")[1]
    for end in "uv":
        found = found.join(vertices.select("graph_id", F.col("node_id").alias(end)), ["graph_id", end], "left_semi")
    return found.select("graph_id", "u", "v")


def documents(rows: DataFrame, key: str) -> DataFrame:
    """(key, document): each row's other columns as a JSON object, nulls included."""
    return rows.select(key, F.to_json(F.struct(*(c for c in rows.columns if c != key)), {"ignoreNullFields": "false"}).alias("document"))


def write_documents(rows: DataFrame, key: str, path: str) -> None:
    """One line of JSON for each row, spread over as many files as there are partitions."""
    documents(rows, key).select("document").write.mode("overwrite").text(path)
