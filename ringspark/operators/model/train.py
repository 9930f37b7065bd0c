"""Training of the degree model on the driver with numpy; inference is in :mod:`layers`.

Four layers 4-h-h-h-1; the first three are followed by batch normalisation, positive part and
dropout.  Gradients are written out by hand, and Adam takes the steps.  Training graphs are
small random ones, so nothing here grows with the data that the model is applied to.
"""

from __future__ import annotations

from typing import Any

import numpy as np

Layer = dict[str, np.ndarray]
EPS, DROPOUT, MOMENTUM = 1e-5, 0.2, 0.1


def sample(rng: np.random.Generator, nodes: tuple[int, int] = (5, 12), prob: tuple[float, float] = (0.15, 0.60), loop: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(adjacency with loops counted twice, features, degrees) of a random graph."""
    n, p = int(rng.integers(nodes[0], nodes[1] + 1)), rng.uniform(*prob)
    upper = np.triu(rng.random((n, n)) < p, 1)
    a = (upper | upper.T).astype(float) + 2 * np.diag(rng.random(n) < loop)
    x = np.c_[np.arange(n) / max(n - 1, 1), rng.normal(size=(n, 2)), rng.random(n)]
    return a, x, a.sum(1)


def start(hidden: int, rng: np.random.Generator) -> list[Layer]:
    sizes, layers = [4, hidden, hidden, hidden, 1], []
    for i, o in zip(sizes, sizes[1:], strict=False):
        bound = 1 / np.sqrt(i)
        layer = {"near": rng.uniform(-bound, bound, (o, i)), "own": rng.uniform(-bound, bound, (o, i)), "bias": rng.uniform(-bound, bound, o)}
        if o > 1:
            layer |= {"scale": np.ones(o), "shift": np.zeros(o), "mean": np.zeros(o), "var": np.ones(o)}
        layers.append(layer)
    return layers


def forward(layers: list[Layer], a: np.ndarray, x: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, list[dict[str, Any]]]:
    """Output of each vertex; with rng in training mode, and what the gradients need."""
    tape: list[dict[str, Any]] = []
    for layer in layers:
        near = a @ x
        z = near @ layer["near"].T + x @ layer["own"].T + layer["bias"]
        own: dict[str, Any] = {"x": x, "near": near}
        if "scale" in layer:
            mean, var = (z.mean(0), z.var(0)) if rng is not None else (layer["mean"], layer["var"])
            if rng is not None:
                unbiased = var * len(z) / max(len(z) - 1, 1)
                layer["mean"] += MOMENTUM * (mean - layer["mean"])
                layer["var"] += MOMENTUM * (unbiased - layer["var"])
            hat = (z - mean) / np.sqrt(var + EPS)
            y = np.maximum(0, hat * layer["scale"] + layer["shift"])
            mask = (rng.random(y.shape) >= DROPOUT) / (1 - DROPOUT) if rng is not None else np.ones_like(y)
            own |= {"hat": hat, "var": var, "y": y, "mask": mask}
            x = y * mask
        else:
            x = z
        tape.append(own)
    return x[:, 0], tape


def gradients(layers: list[Layer], a: np.ndarray, tape: list[dict[str, Any]], out: np.ndarray) -> list[Layer]:
    """Of the loss whose derivative by the output is ``out``."""
    grads: list[Layer] = []
    g = out[:, None]
    for layer, own in zip(reversed(layers), reversed(tape), strict=True):
        mine: Layer = {}
        if "scale" in layer:
            g = g * own["mask"] * (own["y"] > 0)
            mine["scale"], mine["shift"] = (g * own["hat"]).sum(0), g.sum(0)
            h = g * layer["scale"]
            g = (h - h.mean(0) - own["hat"] * (h * own["hat"]).mean(0)) / np.sqrt(own["var"] + EPS)
        mine |= {"near": g.T @ own["near"], "own": g.T @ own["x"], "bias": g.sum(0)}
        g = a.T @ (g @ layer["near"]) + g @ layer["own"]
        grads.append(mine)
    return grads[::-1]


class Adam:
    def __init__(self, layers: list[Layer], rate: float):
        self.rate, self.t = rate, 0
        self.m = [{k: np.zeros_like(v) for k, v in x.items()} for x in layers]
        self.v = [{k: np.zeros_like(v) for k, v in x.items()} for x in layers]

    def step(self, layers: list[Layer], grads: list[Layer]) -> None:
        self.t += 1
        for layer, grad, m, v in zip(layers, grads, self.m, self.v, strict=True):
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                layer[k] = layer[k] - self.rate * (m[k] / (1 - 0.9**self.t)) / (np.sqrt(v[k] / (1 - 0.999**self.t)) + 1e-8)


def train_step(layers: list[Layer], optimiser: Adam, a: np.ndarray, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> float:
    """One step on one graph; the mean squared error before it."""
    p, tape = forward(layers, a, x, rng)
    optimiser.step(layers, gradients(layers, a, tape, 2 * (p - y) / len(y)))
    return float(((p - y) ** 2).mean())


def evaluate(layers: list[Layer], rng: np.random.Generator, graphs: int = 100) -> dict[str, float]:
    """Errors as means of graphs' means, accuracy over all vertices, of rounded outputs."""
    mse, mae, right, n = [], [], 0, 0
    for _ in range(graphs):
        a, x, y = sample(rng)
        p = np.maximum(0.0, np.rint(forward(layers, a, x)[0]))
        mse.append(float(((p - y) ** 2).mean()))
        mae.append(float(np.abs(p - y).mean()))
        right, n = right + int((p == y).sum()), n + len(y)
    return {"mean_squared_error": float(np.mean(mse)), "mean_absolute_error": float(np.mean(mae)), "accuracy": 100.0 * right / n if n else 0.0}


def train(epochs: int = 5000, hidden: int = 64, rate: float = 0.005, evaluate_every: int = 20, graphs: int = 10, seed: int = 0) -> tuple[dict, dict[str, Any]]:
    """(model, figures) of the best evaluation: highest accuracy, then least absolute error."""
    rng = np.random.default_rng(seed)
    layers = start(hidden, rng)
    optimiser, best, kept = Adam(layers, rate), None, layers
    for epoch in range(1, epochs + 1):
        loss = float(np.mean([train_step(layers, optimiser, *sample(rng), rng) for _ in range(graphs)]))
        if epoch % evaluate_every == 0 or epoch == epochs:
            found = evaluate(layers, rng)
            key = (found["accuracy"], -found["mean_absolute_error"])
            if best is None or key > best["key"]:
                best = {"key": key, "epoch": epoch, "loss": loss, "metrics": found}
                kept = [{k: v.copy() for k, v in layer.items()} for layer in layers]
    best = best or {"key": None, "epoch": 0, "loss": None, "metrics": None}
    return {"layers": [{k: v.tolist() for k, v in layer.items()} for layer in kept]}, {k: v for k, v in best.items() if k != "key"}
