"""Features, layers and predictions as joins and sums.

Vectors are arrays.  Weights are a long table (layer, tensor, row, col, value), small by its
shape: a model of width h has fewer than 3 h^2 + 20 h numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringspark.functions.basic import uniform

from ..metrics import KEY, adjacency, degrees, dense_index, require

WEIGHTS = "layer int, tensor string, row int, col int, value double"
INPUT = 4


def features(vertices: DataFrame, seed: int = 42) -> DataFrame:
    """(graph_id, node_id, features): normalised index, two normals, one uniform.

    Draws are md5 uniforms of the vertex, so they do not depend on how rows are split over tasks.
    """
    own = dense_index(vertices)
    draw = lambda i: uniform(F.lit(seed), *(F.col(c) for c in KEY), F.lit(i))
    length, turn = F.sqrt(-2 * F.log(1 - draw(0))), 2 * F.pi() * draw(1)
    return own.select(*KEY, F.array("norm", length * F.cos(turn), length * F.sin(turn), draw(2)).alias("features"))


def neighbor_sum(rows: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """(graph_id, node_id, near): sum of neighbours' vectors; a self-loop adds one's own twice."""
    steps = adjacency(edges).join(rows.select("graph_id", F.col("node_id").alias("dst"), "features"), ["graph_id", "dst"])
    total = steps.groupBy("graph_id", F.col("src").alias("node_id")).agg(*(F.sum(F.col("features")[i]).alias(f"s{i}") for i in range(width)))
    zero = F.array(*(F.lit(0.0) for _ in range(width)))
    return rows.join(total.select(*KEY, F.array(*(F.col(f"s{i}") for i in range(width))).alias("near")), KEY, "left").withColumn("near", F.coalesce("near", zero))


def dot(vector: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(vector, F.array(*(F.lit(float(w)) for w in weights)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def sage(rows: DataFrame, edges: DataFrame, near: list[list[float]], own: list[list[float]], bias: list[float]) -> DataFrame:
    """One layer: near . (sum of neighbours) + bias + own . (one's own vector)."""
    summed = neighbor_sum(rows, edges, len(near[0]))
    out = F.array(*(dot(F.col("near"), a) + F.lit(float(c)) + dot(F.col("features"), b) for a, b, c in zip(near, own, bias, strict=True)))
    return summed.select(*KEY, out.alias("features"))


def normalised(rows: DataFrame, mean: list[float], var: list[float], scale: list[float], shift: list[float], eps: float = 1e-5) -> DataFrame:
    """Batch normalisation with stored figures, then the positive part."""
    out = [F.greatest(F.lit(0.0), (F.col("features")[i] - m) / (v + eps) ** 0.5 * s + b) for i, (m, v, s, b) in enumerate(zip(mean, var, scale, shift, strict=True))]
    return rows.select(*KEY, F.array(*out).alias("features"))


def dropout(rows: DataFrame, share: float, width: int, seed: int = 0) -> DataFrame:
    """Features of training: each is 0 with the probability ``share``, by a draw of its own, the others grow to make up for it."""
    if not 0 <= share < 1:
        raise ValueError("the share of dropped features must be at least 0 and under 1")
    out = [F.when(uniform(F.lit(seed), *(F.col(c) for c in KEY), F.lit(i)) < share, 0.0).otherwise(F.col("features")[i] / (1 - share)) for i in range(width)]
    return rows.select(*KEY, F.array(*out).alias("features"))


def batch_figures(rows: DataFrame, width: int) -> DataFrame:
    """(dim, mean, var): figures of the batch that training normalises by."""
    long = rows.select(F.posexplode("features").alias("dim", "value")).filter(F.col("dim") < width)
    return long.groupBy("dim").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"))


def forward(rows: DataFrame, edges: DataFrame, model: dict) -> DataFrame:
    """(graph_id, node_id, score) of the trained layers; model: see :mod:`train`."""
    for i, layer in enumerate(model["layers"]):
        rows = sage(rows, edges, layer["near"], layer["own"], layer["bias"])
        if i < len(model["layers"]) - 1:
            rows = normalised(rows, layer["mean"], layer["var"], layer["scale"], layer["shift"])
    return rows.select(*KEY, F.col("features")[0].alias("score"))


def predict(vertices: DataFrame, edges: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """(graph_id, node_id, true_degree, predicted_degree): scores rounded half to even, at least
    0; the true degree where there is no score or no model."""
    own = degrees(vertices, edges).withColumnRenamed("degree", "true_degree")
    if scores is None:
        return own.withColumn("predicted_degree", F.col("true_degree").cast("double"))
    rounded = F.greatest(F.rint("score"), F.lit(0.0))
    return own.join(scores, KEY, "left").select(*KEY, "true_degree", F.coalesce(rounded, F.col("true_degree").cast("double")).alias("predicted_degree"))


def attach(vertices: DataFrame, predictions: DataFrame) -> DataFrame:
    """Vertices with their prediction and whether it is wrong; null where there is none."""
    found = vertices.join(predictions.select(*KEY, "true_degree", "predicted_degree"), KEY, "left")
    return found.withColumn("has_prediction", F.col("predicted_degree").isNotNull()).withColumn("is_wrong", F.col("predicted_degree") != F.col("true_degree"))


def evaluate(predictions: DataFrame) -> DataFrame:
    """(mse, mae, accuracy): errors are means of the graphs' means, accuracy is over all vertices."""
    error = F.col("predicted_degree") - F.col("true_degree")
    graphs = predictions.groupBy("graph_id").agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.count_if(error == 0).alias("right"), F.count("*").alias("n"))
    share = F.coalesce(100.0 * F.sum("right") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0))
    return graphs.agg(F.avg("mse").alias("mse"), F.avg("mae").alias("mae"), share.alias("accuracy"))


def save_weights(spark: SparkSession, model: dict, path: str) -> None:
    rows = [(i, name, r, c, float(v)) for i, layer in enumerate(model["layers"]) for name, t in layer.items() for r, line in enumerate(t) for c, v in enumerate(line if isinstance(line, list) else [line])]
    spark.createDataFrame(rows, WEIGHTS).coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict:
    """The model of a weights table; a bounded number of rows comes to the driver."""
    layers: list[dict] = []
    for r in sorted(spark.read.schema(WEIGHTS).parquet(path).collect()):
        while len(layers) <= r["layer"]:
            layers.append({})
        lines = layers[r["layer"]].setdefault(r["tensor"], [])
        while len(lines) <= r["row"]:
            lines.append([])
        lines[r["row"]].append(r["value"])
    matrix = ("near", "own")
    return {"layers": [{k: v if k in matrix else [x[0] for x in v] for k, v in layer.items()} for layer in layers]}


def seeded(vertices: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """(graph_id, node_id, features): md5 uniforms of the vertex, the same in every run and engine."""
    return vertices.select(*KEY, F.array(*(uniform(F.lit(seed), *(F.col(c) for c in KEY), F.lit(i)) for i in range(width))).alias("features"))


def training_rows(vertices: DataFrame, edges: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(graph_id, node_id, features, label) with the degree as the label, and the adjacency."""
    label = degrees(vertices, edges).select(*KEY, F.col("degree").cast("double").alias("label"))
    return features(vertices, seed).join(label, KEY), adjacency(edges)


def predict_some(vertices: DataFrame, edges: DataFrame, wanted: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Predictions of the vertices (graph_id, node_id) asked for; one that does not exist fails the query."""
    asked = require(vertices, wanted.select(*KEY))
    return predict(vertices, edges, scores).join(asked, KEY, "left_semi")


_LOADED: dict[str, tuple[int, dict]] = {}


def written_at(spark: SparkSession, path: str) -> int:
    """When the newest file under a path was written, in milliseconds."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    found, times = place.getFileSystem(sc._jsc.hadoopConfiguration()).listFiles(place, True), [0]
    while found.hasNext():
        times.append(found.next().getModificationTime())
    return max(times)


def cached_weights(spark: SparkSession, path: str) -> dict:
    """As :func:`load_weights`, read again only when the path was written again."""
    now = written_at(spark, path)
    if path not in _LOADED or _LOADED[path][0] != now:
        _LOADED[path] = now, load_weights(spark, path)
    return _LOADED[path][1]
