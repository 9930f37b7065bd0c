"""A generalised additive model with pairwise interactions for text quality.

Twenty figures of each text are cut into at most 32 bins.  Training goes round the features,
each time growing a tree of three splits over one feature's bins on the current gradients and
adding its shrunken leaf values to that feature's lookup table; the pairs with the strongest
remaining gradients then get tables of their own, grown by one cut along either axis.  A score
is the logistic of the intercept plus one table entry for each feature and pair, all added as
arrays.

The model is fitted on a bounded sample of ``TRAIN_ROWS`` labelled rows outside the held-out
fold; every document is scored.  Neither labels nor lang, source or id enter a score.

Defined results: a null or empty text has figures of 0 and is scored like any other; without
labels, or with one label only, every score is the smoothed share of label 1; repeated rows are
scored as often as they come; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, labelled, texts

NAMES = ("chars", "words", "word_length", "symbols", "bangs", "upper", "digits", "wide", "bars", "stops", "commas", "distinct", "top_word", "lines", "line_length", "dup_lines", "short_lines", "short_words", "closed_words", "longest")
TRAIN_ROWS = 20_000
BINS, COARSE, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, RIDGE = 32, 8, 120, 6, 40, 0.15, 5.0


class Model(NamedTuple):
    intercept: float
    edges: list[np.ndarray]
    tables: np.ndarray
    pairs: list[tuple[int, int]]
    grids: np.ndarray


def figures(text: str) -> tuple[float, ...]:
    raw = text.encode()
    words = raw.split()
    if not words:
        return (0.0,) * len(NAMES)
    of = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n, size = len(words), len(raw)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()] or [text]
    symbols = sum(int(of[ord(c)]) for c in "#*$%&|<>")
    return (
        np.log1p(size), np.log1p(n), float(lengths.mean()), symbols / n, of[33] / n, of[65:91].sum() / size, of[48:58].sum() / size,
        of[192:].sum() / size, of[124] / n, of[46] / n, of[44] / n, len(counts) / n, max(counts.values()) / n,
        100 * len(lines) / n, np.log1p(size / len(lines)), 1 - len(set(lines)) / len(lines), sum(len(x) < 20 for x in lines) / len(lines),
        float((lengths <= 3).mean()), float((lengths >= 12).mean()), np.log1p(lengths.max()),
    )


def feature_table(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                x = np.array([figures(t) for t in part.column(1).to_pylist()], dtype=np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in np.ascontiguousarray(x.T))], ["doc_id", *NAMES])

    return texts(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} float" for c in NAMES))


def steps(grad: np.ndarray, hess: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values for each bin of the tree with ``depth`` splits, best gain first."""
    bounds, g, h = [0, len(grad)], np.r_[0, np.cumsum(grad)], np.r_[0, np.cumsum(hess)]
    value = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + RIDGE)
    for _ in range(depth):
        best = (1e-9, 0)
        for a, b in zip(bounds, bounds[1:], strict=False):
            inner = np.arange(a + 1, b)
            if len(inner):
                gain = value(a, inner) + value(inner, b) - value(a, b)
                i = int(gain.argmax())
                best = max(best, (float(gain[i]), int(inner[i])))
        if not best[1]:
            break
        bounds = sorted([*bounds, best[1]])
    out = np.zeros(len(grad))
    for a, b in zip(bounds, bounds[1:], strict=False):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + RIDGE)
    return out


def corner(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best pair of cuts of a grid, one along either axis."""
    g, h = (np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0))) for x in (grad, hess))
    k = len(grad)
    parts = lambda s: (s[1:k, 1:k], s[1:k, k:] - s[1:k, 1:k], s[k:, 1:k] - s[1:k, 1:k], s[k, k] - s[1:k, k:] - s[k:, 1:k] + s[1:k, 1:k])
    gs, hs = parts(g), parts(h)
    gain = sum(a**2 / (b + RIDGE) for a, b in zip(gs, hs, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros((k, k))
    for (rows, columns), a, b in zip(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, k)), (slice(i + 1, k), slice(0, j + 1)), (slice(i + 1, k), slice(j + 1, k))), gs, hs, strict=True):
        out[rows, columns] = a[i, j] / (b[i, j] + RIDGE)
    return float(gain[i, j] - g[k, k] ** 2 / (h[k, k] + RIDGE)), out


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)])


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting on binned features; with one label only, the intercept alone."""
    k = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    tables, grids = np.zeros((k, BINS)), np.zeros((0, COARSE, COARSE))
    intercept = float(np.log(share / (1 - share)))
    if len(y) < 20 or not 0 < y.sum() < len(y):
        return Model(intercept, [np.zeros(0)] * k, tables, [], grids)
    edges = [np.unique(np.quantile(x[:, i], np.arange(1, BINS) / BINS, method="inverted_cdf")).astype(np.float32) for i in range(k)]
    bins = binned(x, edges)
    total = np.full(len(y), intercept)
    for _ in range(ROUNDS):
        for i in range(k):
            p = logistic(total)
            step = RATE * steps(np.bincount(bins[i], y - p, BINS), np.bincount(bins[i], p * (1 - p), BINS), 3)
            tables[i] += step
            total += step[bins[i]]
    p = logistic(total)
    coarse = bins * COARSE // BINS
    grid = lambda a, b, w: np.bincount(coarse[a] * COARSE + coarse[b], w, COARSE * COARSE).reshape(COARSE, COARSE)
    gains = sorted(((-corner(grid(a, b, y - p), grid(a, b, p * (1 - p)))[0], a, b) for a in range(k) for b in range(a + 1, k)))
    pairs = [(a, b) for _, a, b in gains[:PAIRS]]
    grids = np.zeros((len(pairs), COARSE, COARSE))
    for _ in range(PAIR_ROUNDS):
        for n, (a, b) in enumerate(pairs):
            p = logistic(total)
            step = RATE * corner(grid(a, b, y - p), grid(a, b, p * (1 - p)))[1]
            grids[n] += step
            total += step[coarse[a], coarse[b]]
    return Model(intercept, edges, tables, pairs, grids)


def predict(model: Model, x: np.ndarray) -> np.ndarray:
    bins = binned(x, model.edges)
    coarse = bins * COARSE // BINS
    total = np.full(len(x), model.intercept)
    for table, b in zip(model.tables, bins, strict=True):
        total += table[b]
    for (a, b), grid in zip(model.pairs, model.grids, strict=True):
        total += grid[coarse[a], coarse[b]]
    return logistic(total)


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    features = cut(feature_table(docs), "quality")
    sample = labelled(features, labels, label, fold("doc_id", folds) != held, rows)
    data = np.array([[r[c] for c in (*NAMES, "y")] for r in sample], dtype=np.float32).reshape(-1, len(NAMES) + 1)
    model = train(data[:, :-1], data[:, -1].astype(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = predict(model, np.stack([np.asarray(c) for c in batch.columns[2:]], axis=1)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return features.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), *NAMES).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
