"""Training of the degree model over graphs that lie in tables: a step is one Spark job.

Each partition adds up the gradients of its graphs; Spark sums the partitions' vectors place by
place, and only numbers of the size of the weights (under 4 h^2) reach the driver, which takes the
step.  Batch normalisation is over the vertices of a graph, so a graph lies in one row, with its
steps: what a task holds follows the vertices and edges of a graph.  :func:`arrays` makes a dense
adjacency and is for small graphs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringspark.operators.lineage import held

from . import layers as columns
from . import train
from .train import Layer

GRADIENTS, STATISTICS = ("near", "own", "bias", "scale", "shift"), ("mean", "var")


def graph_rows(vertices: DataFrame, edges: DataFrame, seed: int = 42) -> DataFrame:
    """(graph_id, nodes, steps): one row for each graph with its features, degrees and adjacency, written once."""
    rows, steps = columns.training_rows(vertices, edges, seed)
    nodes = rows.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "features", "label"))).alias("nodes"))
    near = steps.groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst")).alias("steps"))
    return held(nodes.join(near, "graph_id", "left"), "training")


def arrays(nodes: Any, steps: Any) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(adjacency with loops counted twice, features, degrees) of a row's graph."""
    at = {r["node_id"]: i for i, r in enumerate(nodes)}
    a = np.zeros((len(at), len(at)))
    for r in steps if steps is not None else ():
        a[at[r["src"]], at[r["dst"]]] += 1
    return a, np.array([list(r["features"]) for r in nodes], dtype=float), np.array([r["label"] for r in nodes], dtype=float)


class Steps:
    """An adjacency as its steps, with the products that training asks for; what it holds follows the edges."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray):
        order = np.argsort(src, kind="stable")
        self.n, self.src, self.dst = n, src, dst
        self.near = dst[order]
        self.rows, self.starts = np.unique(src[order], return_index=True)

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, x.shape[1]))
        if len(self.near):
            out[self.rows] = np.add.reduceat(x[self.near], self.starts, axis=0)
        return out

    @property
    def T(self) -> "Steps":
        return Steps(self.n, self.dst, self.src)


def sparse(nodes: pa.StructArray, steps: pa.StructArray | None) -> tuple[Steps, np.ndarray, np.ndarray]:
    """As :func:`arrays`, of a row's Arrow values; nodes come in the order of their ids."""
    own = dict(zip((f.name for f in nodes.type), nodes.flatten(), strict=True))
    ids, features, labels = (own[c] for c in ("node_id", "features", "label"))
    ids = ids.to_numpy(zero_copy_only=False)
    src, dst = (np.searchsorted(ids, c.to_numpy(zero_copy_only=False)) for c in (steps.flatten()[steps.type.get_field_index(x)] for x in ("src", "dst"))) if steps is not None else (np.zeros(0, int), np.zeros(0, int))
    return Steps(len(ids), src, dst), features.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1), labels.to_numpy(zero_copy_only=False).astype(float)


def flat(layers: list[Layer], names: tuple[str, ...]) -> np.ndarray:
    return np.concatenate([layer[k].ravel() for layer in layers for k in names if k in layer])


def shaped(values: np.ndarray, like: list[Layer], names: tuple[str, ...]) -> list[Layer]:
    """The inverse of :func:`flat`."""
    out, start = [], 0
    for layer in like:
        mine: Layer = {}
        for k in names:
            if k in layer:
                mine[k] = values[start : start + layer[k].size].reshape(layer[k].shape)
                start += layer[k].size
        out.append(mine)
    return out


def contribution(layers: list[Layer], name: str, graph: tuple[np.ndarray, np.ndarray, np.ndarray], seed: int) -> np.ndarray:
    """One graph, its loss, gradients and changes of the running statistics, as one vector.

    Dropout draws come from the seed and the graph's name, so a partition that is computed again
    gives the same.
    """
    own = [{k: v.copy() for k, v in layer.items()} for layer in layers]
    a, x, y = graph
    p, tape = train.forward(own, a, x, np.random.default_rng([seed, crc32(name.encode())]))
    grads = train.gradients(own, a, tape, 2 * (p - y) / len(y))
    return np.concatenate([[1.0, ((p - y) ** 2).mean()], flat(grads, GRADIENTS), flat(own, STATISTICS) - flat(layers, STATISTICS)])


def summed(graphs: DataFrame, layers: list[Layer], seed: int) -> DataFrame:
    """(place, value): the sum of all graphs' contributions."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for name, nodes, steps in zip(*(batch.column(c) for c in ("graph_id", "nodes", "steps")), strict=True):
                mine = contribution(layers, name.as_py(), sparse(nodes.values, steps.values), seed)
                total = mine if total is None else total + mine
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "value"])

    return graphs.select("graph_id", "nodes", "steps").mapInArrow(part, "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value"))


def gradient(graphs: DataFrame, layers: list[Layer], seed: int = 0) -> tuple[int, float, list[Layer], list[Layer]]:
    """(graphs, mean loss, mean gradients, mean changes of the statistics); zeros of all without graphs."""
    rows = summed(graphs, layers, seed).collect()  # as many numbers as the model has weights
    size = flat(layers, GRADIENTS).size
    total = np.zeros(2 + size + flat(layers, STATISTICS).size)
    for r in rows:
        total[r["place"]] = r["value"]
    n = int(total[0])
    mean = total / max(n, 1)
    return n, float(mean[1]), shaped(mean[2 : 2 + size], layers, GRADIENTS), shaped(mean[2 + size :], layers, STATISTICS)


def fit(graphs: DataFrame, epochs: int, hidden: int = 16, rate: float = 0.01, seed: int = 0) -> tuple[dict, list[float]]:
    """(model, mean loss before each step) of full-batch training; the model is what :mod:`layers` reads."""
    own = train.start(hidden, np.random.default_rng(seed))
    optimiser, losses = train.Adam(own, rate), []
    for epoch in range(epochs):
        n, loss, grads, change = gradient(graphs, own, seed + epoch)
        if not n:
            break
        losses.append(loss)
        optimiser.step(own, grads)
        for layer, by in zip(own, change, strict=True):
            for k, v in by.items():
                layer[k] = layer[k] + v
    return {"layers": [{k: v.tolist() for k, v in layer.items()} for layer in own]}, losses
