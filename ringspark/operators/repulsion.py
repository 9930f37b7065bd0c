"""Repulsion between all vertices of a graph through a hierarchy of square cells.

A cell splits into four while more than LEAF places lie in it.  A cell far enough from a place acts
on it as a whole, through its mass, centre and second moments.  Where it is nearer its parts act,
and those of a leaf are its places.

Cells of at most BLOCK places are dealt out as blocks.  Rounds from the root down find for each
block the cells that may act on any of its places: a cell is there if what it is a part of is not
far from the whole block.  A task takes a block's places with these cells, and the places of the
leaves near it, and sums in arrays.  Pairs are rows only of blocks and cells; those of places and
cells are never written.

Bound: with h the radius of a cell and r the least distance of its places, the remainder of its
expansion is at most 4 h^3 / r^5 for a unit of mass.  Cells act as wholes only where that is at most
``tolerance`` / R^2, R the largest distance, so the error of the force on a vertex is at most
``tolerance`` times the sum of the magnitudes of the forces of all others on it.  With t the distance
of the centre, that is so from some multiple of h on, see :func:`multiple`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indexes import numbered
from .lineage import held

DEPTH, LEAF, LEAST = 28, 8, 0.1
#: Places of a block, of a group that meets the same cells, and sources that meet it at a time.
BLOCK, GROUP, STRIP = 4_096, 32, 4_096
#: Rows of the order along the quadrants in one window.
CHUNK = 32_768
TARGET, CELL, PLACE = 0, 1, 2
SENT = ["graph_id", "block", "turn", "kind", "cell", "up", "n", "x", "y", "cxx", "cxy", "cyy", "reach"]


def cell_id(level: Column, ix: Column, iy: Column) -> Column:
    """One number for a cell; ix and iy count cells of the deepest level."""
    up = F.lit(DEPTH) - level
    across = F.call_function("shiftright", ix, up)
    down = F.call_function("shiftright", iy, up)
    return F.shiftleft(level.cast("bigint"), 2 * DEPTH).bitwiseOR(F.shiftleft(across, DEPTH)).bitwiseOR(down)


def places(positions: DataFrame) -> DataFrame:
    """Distinct places of each graph: (graph_id, x, y, m, x0, y0, side, ix, iy), m vertices at each.

    Vertices without a finite place take no part.
    """
    finite = " AND ".join(f"abs({c}) < double('infinity')" for c in "xy")
    own = held(positions.filter(finite).select("graph_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).groupBy("graph_id", "x", "y").agg(F.count("*").alias("m")), "places")
    frame = own.groupBy("graph_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("wide"))
    frame = held(frame.select("graph_id", "x0", "y0", F.when(F.col("wide") > 0, F.col("wide")).otherwise(1.0).alias("side")), "frames")
    cells = 2**DEPTH
    at = lambda c: F.least(F.lit(cells - 1), F.floor((F.col(c) - F.col(f"{c}0")) / F.col("side") * cells)).cast("bigint").alias(f"i{c}")
    return own.join(frame, "graph_id").select("graph_id", "x", "y", "m", "x0", "y0", "side", at("x"), at("y"))


def with_leaves(own: DataFrame) -> DataFrame:
    """Places with the level and number of their leaf cell.

    In the order along the quadrants, a cell with more than LEAF places holds LEAF + 1 neighbours
    in a row; a place's deepest such cell is the parent of its leaf.
    """
    along = F.expr(f"aggregate(sequence(0, {DEPTH - 1}), 0L, (a, i) -> a | shiftleft((shiftright(ix, i) & 1L) * 2 + (shiftright(iy, i) & 1L), 2 * i))")
    row = held(numbered(own.withColumn("code", along), ["graph_id"], ["code"], "i"), "ordered")
    chunk = lambda by: F.floor((F.col("i") + by) / CHUNK)
    rows = row.withColumn("chunk", F.explode(F.array_distinct(F.array(chunk(-LEAF), chunk(0), chunk(LEAF)))))
    window = Window.partitionBy("graph_id", "chunk").orderBy("i")
    differ = F.col("code").bitwiseXOR(F.lead("code", LEAF).over(window))
    rows = rows.withColumn("shared", DEPTH - F.when(differ == 0, 0).otherwise(F.ceil(F.length(F.bin(differ)) / 2)))
    rows = rows.withColumn("opened", F.max("shared").over(window.rowsBetween(-LEAF, 0))).filter(F.col("chunk") == chunk(0))
    level = F.least(F.lit(DEPTH), F.coalesce(F.col("opened") + 1, F.lit(0))).cast("int")
    return rows.withColumn("leaf", level).withColumn("cell", cell_id(F.col("leaf"), F.col("ix"), F.col("iy"))).drop("i", "code", "chunk", "shared", "opened")


def above(cell: Column, level: Column, at: Column) -> Column:
    """The number of the cell at a level over a cell of another."""
    half = lambda c: F.call_function("shiftright", c.bitwiseAND(F.lit(2**DEPTH - 1)), level - at)
    return F.shiftleft(at.cast("bigint"), 2 * DEPTH).bitwiseOR(F.shiftleft(half(F.shiftright(cell, DEPTH)), DEPTH)).bitwiseOR(half(cell))


def hierarchy(points: DataFrame) -> DataFrame:
    """Cells with a place in them: number, parent, level, mass, places, centre, second moments, radius, leaf or not.

    Sums are taken from the cell's own corner, so that they keep their digits in small cells; those
    of a leaf are moved to the corners of the cells above it.
    """
    level, deepest = F.col("level"), F.col("deepest")
    width = lambda of: F.col("side") / F.pow(F.lit(2.0), of)
    corner = lambda c, of: F.col(f"{c}0") + F.floor(F.col(f"i{c}") / F.pow(F.lit(2.0), DEPTH - of)) * width(of)
    dx, dy = (F.col(c) - corner(c, F.col("leaf")) for c in "xy")
    rows = points.withColumns({"dx": dx, "dy": dy})
    dx, dy, m = F.col("dx"), F.col("dy"), F.col("m")
    frame = [F.first(c).alias(c) for c in ("x0", "y0", "side", "ix", "iy")]
    ends = [(f"{name}{c}", f) for c in "xy" for name, f in (("low", F.min), ("top", F.max))]
    leaves = rows.groupBy("graph_id", "cell", F.col("leaf").alias("deepest")).agg(
        F.sum("m").cast("double").alias("n"), F.count("*").alias("places"), *frame, F.sum(m * dx).alias("sx"), F.sum(m * dy).alias("sy"), F.sum(m * dx * dx).alias("sxx"), F.sum(m * dx * dy).alias("sxy"), F.sum(m * dy * dy).alias("syy"),
        *(f(f"d{name[-1]}").alias(name) for name, f in ends),
    )
    up = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), "deepest")))
    up = up.withColumns({f"c{c}": corner(c, level) for c in "xy"}).withColumns({f"o{c}": corner(c, deepest) - F.col(f"c{c}") for c in "xy"})
    n, ox, oy, sx, sy = (F.col(c) for c in ("n", "ox", "oy", "sx", "sy"))
    moved = {"sx": sx + n * ox, "sy": sy + n * oy, "sxx": F.col("sxx") + 2 * ox * sx + n * ox * ox, "sxy": F.col("sxy") + ox * sy + oy * sx + n * ox * oy, "syy": F.col("syy") + 2 * oy * sy + n * oy * oy}
    moved |= {name: F.col(name) + F.col(f"o{name[-1]}") for name, _ in ends}
    up = up.select("graph_id", "level", above(F.col("cell"), deepest, level).alias("cell"), (level == deepest).alias("leaf"), "n", "places", "cx", "cy", *(c.alias(name) for name, c in moved.items()))
    found = up.groupBy("graph_id", "level", "cell").agg(
        F.sum("n").alias("n"), F.sum("places").alias("places"), F.first("leaf").alias("leaf"), F.first("cx").alias("cx"), F.first("cy").alias("cy"),
        *(F.sum(c).alias(c) for c in ("sx", "sy", "sxx", "sxy", "syy")), *(f(name).alias(name) for name, f in ends),
    )
    mx, my = F.col("sx") / n, F.col("sy") / n
    reach = lambda mean, c: F.greatest(F.col(f"top{c}") - mean, mean - F.col(f"low{c}"))
    return found.select("graph_id", "cell", F.when(level > 0, above(F.col("cell"), level, level - 1)).alias("up"), "level", "leaf", "n", "places", (F.col("cx") + mx).alias("ax"), (F.col("cy") + my).alias("ay"),
                        (F.col("sxx") / n - mx * mx).alias("cxx"), (F.col("sxy") / n - mx * my).alias("cxy"), (F.col("syy") / n - my * my).alias("cyy"), F.hypot(reach(mx, "x"), reach(my, "y")).alias("rho"))


def multiple(tolerance: float) -> float:
    """The least c, nearly, for which 4 h^3 (t + h)^2 <= tolerance (t - h)^5 wherever t >= c h."""
    if tolerance <= 0:
        return math.inf
    low, high = 1.0, 2.0
    fits = lambda c: 4 * (c + 1) ** 2 <= tolerance * (c - 1) ** 5
    while not fits(high):
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high * (1 + 1e-9)


def dealt(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Places with their block: the largest cell over them that has at most BLOCK places.

    A leaf with more (places closer than the deepest cell is wide) is dealt into turns.
    """
    few = cells.filter(F.col("leaf") | (F.col("places") <= BLOCK)).select("graph_id", "cell", "up", "places")
    many = cells.filter(F.col("places") > BLOCK).filter("NOT leaf").select("graph_id", F.col("cell").alias("up"), F.lit(True).alias("split"))
    block = held(few.join(many, ["graph_id", "up"], "left").filter("split OR up IS NULL").select("graph_id", F.col("cell").alias("block"), F.ceil(F.col("places") / BLOCK).alias("turns")), "blocks")
    leaves = cells.filter("leaf").select("graph_id", "cell", F.explode(F.transform(F.sequence(F.lit(0), "level"), lambda at: above(F.col("cell"), F.col("level"), at))).alias("block"))
    own = leaves.join(block, ["graph_id", "block"])
    return held(points.select("graph_id", "cell", "x", "y", "m").join(own, ["graph_id", "cell"]).withColumn("turn", F.pmod(F.xxhash64("x", "y"), F.col("turns"))).drop("turns"), "dealt")


def needed(own: DataFrame, cells: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(cells, near): what may act on places of a block, with the parents above it, and the leaves whose places do.

    A round for each level of the hierarchy; own: places as of :func:`dealt`.
    """
    key, c = ["graph_id", "block", "turn"], multiple(tolerance)
    ends = [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]
    box = held(own.groupBy(*key).agg(*ends), "boxes")
    wide = F.when(F.col("rho") > 0, F.col("rho") * c).otherwise(0.0)
    reach = F.greatest(wide, F.col("rho") + LEAST * (1 + 1e-9))  # whether a place is at least LEAST away is never up to a cell
    parts = held(cells.select("graph_id", "cell", "up", "level", "leaf", "n", F.col("ax").alias("x"), F.col("ay").alias("y"), "cxx", "cxy", "cyy", reach.alias("reach")), "parts")
    off = lambda s: F.greatest(F.col(f"{s}0") - F.col(s), F.col(s) - F.col(f"{s}1"), F.lit(0.0))
    far = F.hypot(off("x"), off("y")) >= F.col("reach")
    kind = F.when(far, "far").when(F.col("leaf"), "near").otherwise("open")
    figures = [*SENT[4:], "leaf"]
    met, level = [], 0
    pairs = box.join(parts.filter("level = 0").drop("level"), "graph_id")
    while True:
        pairs = held(pairs.select(*key, "x0", "x1", "y0", "y1", *figures).withColumn("what", kind), "pairs")
        met.append(pairs)
        left = pairs.filter("what = 'open'")
        if left.isEmpty():
            break
        level += 1
        left = left.select(*key, "x0", "x1", "y0", "y1", F.col("cell").alias("up"))
        pairs = left.join(parts.filter(F.col("level") == level).drop("level"), ["graph_id", "up"])
    every = union(met)
    return every.select(*key, F.lit(CELL).alias("kind"), *SENT[4:]), every.filter("what = 'near'").select(*key, "cell")


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.union(df)
    return out


def groups(x: np.ndarray, y: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of at most GROUP places each that lie together."""
    todo = [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= GROUP:
            yield own
            continue
        along = x if np.ptp(x[own]) >= np.ptp(y[own]) else y
        order, half = np.argpartition(along[own], len(own) // 2), len(own) // 2
        todo += [own[order[:half]], own[order[half:]]]


def runs(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers from each start to before its end."""
    size = end - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def summed(table: pa.Table) -> pa.Table:
    """(graph_id, x, y, gx, gy, n) of the places of a block; rows are those of SENT."""
    kind = table.column("kind").to_numpy()
    of = lambda k, names: [table.column(c).to_numpy()[kind == k] for c in names]
    tx, ty = of(TARGET, ("x", "y"))
    cell, up, n, ax, ay, cxx, cxy, cyy, reach = (c[0] for c in (of(CELL, (name,)) for name in SENT[4:]))
    order = np.argsort(up, kind="stable")
    cell, up, n, ax, ay, cxx, cxy, cyy, reach = (c[order] for c in (cell, up, n, ax, ay, cxx, cxy, cyy, reach))
    inside, m, px, py = of(PLACE, ("cell", "n", "x", "y"))
    order = np.argsort(inside, kind="stable")
    inside, m, px, py = (c[order] for c in (inside, m, px, py))
    child, last = np.searchsorted(up, cell, "left"), np.searchsorted(up, cell, "right")
    first, end = np.searchsorted(inside, cell, "left"), np.searchsorted(inside, cell, "right")
    leaf, bare = end > first, (end == first) & (last == child)  # bare ones are far from the whole block
    gx, gy, acting = np.zeros(len(tx)), np.zeros(len(tx)), np.zeros(len(tx))
    for own in groups(tx, ty):
        x, y = tx[own, None], ty[own, None]
        at, whole, near = np.flatnonzero(up < 0), [], []
        while len(at):
            dx = np.maximum(np.maximum(x.min() - ax[at], ax[at] - x.max()), 0.0)
            dy = np.maximum(np.maximum(y.min() - ay[at], ay[at] - y.max()), 0.0)
            far = bare[at] | (np.sqrt(dx * dx + dy * dy) >= reach[at])
            whole.append(at[far])
            left = at[~far]
            near.append(left[leaf[left]])
            left = left[~leaf[left]]
            at = runs(child[left], last[left])
        far, near = np.concatenate(whole), np.concatenate(near)
        near = runs(first[near], end[near])
        acting[own] += n[far].sum()
        for s in (far[i : i + STRIP] for i in range(0, len(far), STRIP)):
            p, q = x - ax[s], y - ay[s]
            r2 = 1.0 / (p * p + q * q)
            r3 = r2 * np.sqrt(r2) * n[s]
            r5 = r3 * r2
            u, v = p * cxx[s] + q * cxy[s], p * cxy[s] + q * cyy[s]
            by = r3 + r5 * (7.5 * r2 * (p * u + q * v) - 1.5 * (cxx[s] + cyy[s]))
            gx[own] += (p * by - 3.0 * r5 * u).sum(axis=1)
            gy[own] += (q * by - 3.0 * r5 * v).sum(axis=1)
        for s in (near[i : i + STRIP] for i in range(0, len(near), STRIP)):
            p, q = x - px[s], y - py[s]
            d = np.sqrt(p * p + q * q)
            there = d >= LEAST
            d[~there] = 1.0
            by = there * m[s] / (d * d * d)
            gx[own] += (p * by).sum(axis=1)
            gy[own] += (q * by).sum(axis=1)
            acting[own] += (there * m[s]).sum(axis=1)
    name = pa.array([table.column("graph_id")[0].as_py()] * len(tx), pa.string())
    return pa.table({"graph_id": name, "x": tx, "y": ty, "gx": gx, "gy": gy, "n": acting})


def forces(positions: DataFrame, strength: float, tolerance: float = 0.05) -> DataFrame:
    """(graph_id, node_id, fx, fy, acting) of each vertex: strength / d^2 away from every other.

    positions: (graph_id, node_id, x, y), other columns are left aside.  ``acting`` counts the
    vertices whose force is in the sum: those at least LEAST away.  The error of (fx, fy) is at
    most ``tolerance`` times the sum of the magnitudes of those forces; with tolerance 0 only
    single places act as wholes.  A vertex whose place is null or not finite acts on nothing and
    has no force; a graph without places gives zeros, an empty table no rows.
    """
    points = held(with_leaves(places(positions)), "points")
    cells = held(hierarchy(points), "cells")
    own = dealt(points, cells)
    wholes, near = needed(own, cells, tolerance)
    zero, none = F.lit(0.0), F.lit(-1).cast("bigint")
    rest = [none.alias("up"), F.col("m").cast("double").alias("n"), "x", "y", *(zero.alias(c) for c in ("cxx", "cxy", "cyy", "reach"))]
    targets = own.select("graph_id", "block", "turn", F.lit(TARGET).alias("kind"), "cell", *rest)
    close = near.join(own.select("graph_id", "cell", "x", "y", "m"), ["graph_id", "cell"]).select("graph_id", "block", "turn", F.lit(PLACE).alias("kind"), "cell", *rest)
    sent = union([targets, wholes.fillna(-1, ["up"]), close]).select(*SENT)
    total = held(sent.groupBy("graph_id", "block", "turn").applyInArrow(summed, "graph_id string, x double, y double, gx double, gy double, n double"), "forces")
    asked = positions.select("graph_id", "node_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    found = asked.join(total, ["graph_id", "x", "y"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return found.select("graph_id", "node_id", (strength * zero("gx")).alias("fx"), (strength * zero("gy")).alias("fy"), zero("n").cast("bigint").alias("acting"))
