"""Repulsion through a hierarchy of cells beside all pairs."""

import math
import random

import pytest

from ringspark.operators import layout, repulsion
from ringspark.plans import catalog

SCHEMA = "graph_id string, node_id long, x double, y double"


def all_pairs(own):
    """{id: (fx, fy, sum of magnitudes, acting)} for a strength of 1."""
    out = {}
    for i, (x, y) in own.items():
        fx = fy = size = 0.0
        acting = 0
        for j, (a, b) in own.items():
            d = math.hypot(x - a, y - b)
            if i != j and d >= repulsion.LEAST:
                fx, fy, size, acting = fx + (x - a) / d**3, fy + (y - b) / d**3, size + 1 / d**2, acting + 1
        out[i] = fx, fy, size, acting
    return out


def clustered():
    """A third of all vertices at one place, a tight cluster far away, and a loose one."""
    rng = random.Random(1)
    own = {i: (rng.gauss(0, 100), rng.gauss(0, 100)) for i in range(150)}
    own |= {i: (5.0, 5.0) for i in range(150, 250)}
    return own | {i: (1e4 + rng.gauss(0, 0.05), 7 + rng.gauss(0, 0.05)) for i in range(250, 300)}


@pytest.mark.parametrize("tolerance", [0.5, 0.05])
def test_error_is_within_the_bound(spark, tolerance):
    own = clustered()
    df = spark.createDataFrame([("g", i, x, y) for i, (x, y) in own.items()], SCHEMA)
    want, got = all_pairs(own), {r.node_id: r for r in repulsion.forces(df, 1.0, tolerance).collect()}
    assert got.keys() == want.keys()
    for i, (fx, fy, size, acting) in want.items():
        assert got[i].acting == acting
        assert math.hypot(got[i].fx - fx, got[i].fy - fy) <= tolerance * size + 1e-12


def test_without_tolerance_all_pairs_meet(spark):
    rng = random.Random(2)
    own = {i: (rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(60)}
    df = spark.createDataFrame([("g", i, x, y) for i, (x, y) in own.items()], SCHEMA)
    want, got = all_pairs(own), {r.node_id: r for r in repulsion.forces(df, 1.0, 0.0).collect()}
    assert all(math.hypot(got[i].fx - w[0], got[i].fy - w[1]) <= 1e-9 * (1 + w[2]) for i, w in want.items())


def test_hierarchy_holds_every_vertex_once_a_level_of_leaves(spark):
    df = spark.createDataFrame([("g", i, x, y) for i, (x, y) in clustered().items()], SCHEMA)
    cells = repulsion.hierarchy(repulsion.with_leaves(repulsion.places(df))).collect()
    own = {c.cell: c for c in cells}
    assert len(own) == len(cells) and sum(c.n for c in cells if c.leaf) == 300
    for c in cells:
        assert c.level == 0 or (not own[c.up].leaf and own[c.up].level == c.level - 1)
    for c in cells:
        assert c.leaf or c.n == sum(x.n for x in cells if x.up == c.cell)


@pytest.mark.parametrize("block", [20, 70])
def test_many_blocks_and_a_leaf_in_turns(spark, monkeypatch, block):
    monkeypatch.setattr(repulsion, "BLOCK", block)
    rng = random.Random(3)
    far = {i: (rng.uniform(0, 900), rng.uniform(0, 900)) for i in range(90)} | {90: (1e12, 0.0)}  # 90 in the deepest cell
    graphs = {"g": clustered(), "h": far}
    df = spark.createDataFrame([(g, i, x, y) for g, own in graphs.items() for i, (x, y) in own.items()], SCHEMA)
    got = {(r.graph_id, r.node_id): r for r in repulsion.forces(df, 1.0).collect()}
    assert len(got) == 391
    for g, own in graphs.items():
        for i, (fx, fy, size, acting) in all_pairs(own).items():
            r = got[g, i]
            assert r.acting == acting and math.hypot(r.fx - fx, r.fy - fy) <= 0.05 * size + 1e-12


def test_pairs_of_cells_are_not_written(spark):
    """Bytes of the tables between follow the places: with pairs of cells 756 a place, now 215."""
    from pathlib import Path

    from ringspark.operators import lineage

    folder = Path(lineage.shared_dir(spark).removeprefix("file://"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    rng = random.Random(4)
    df = spark.createDataFrame([("g", i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(6000)], SCHEMA)
    before = size()
    assert repulsion.forces(df, 1.0).count() == 6000
    assert (size() - before) / 6000 < 400


def test_places_that_are_not_there(spark):
    rows = [("a", 0, 1.0, 2.0), ("a", 1, None, 3.0), ("b", 0, None, 1.0), ("c", 0, math.nan, 0.0), ("c", 1, 0.0, 0.0), ("c", 2, 3.0, 4.0), ("d", 0, 1.0, 1.0), ("d", 1, 1.0, 1.0), ("e", 0, math.inf, 0.0), ("e", 1, 2.0, 0.0)]
    got = {(r.graph_id, r.node_id): (round(r.fx, 9), round(r.fy, 9), r.acting) for r in repulsion.forces(spark.createDataFrame(rows, SCHEMA), 25.0).collect()}
    assert got.pop(("c", 1)) == (-0.6, -0.8, 1) and got.pop(("c", 2)) == (0.6, 0.8, 1)
    assert len(got) == 8 and set(got.values()) == {(0.0, 0.0, 0)}


def test_empty_table(spark):
    found = repulsion.forces(spark.createDataFrame([], SCHEMA), 1.0)
    assert found.collect() == [] and found.columns == ["graph_id", "node_id", "fx", "fy", "acting"]


def test_step_of_a_query_equals_that_of_all_pairs(spark):
    from ringspark.plans import details
    from ringspark.sources import projections

    sf = "/root/testdata/sf0.001"
    start, edges = details.spread(spark, sf), projections.supply(spark, sf)[1]
    want = {r.node_id: r for r in layout.legacy_step(start, edges).collect()}
    got = catalog.QUERIES["layout_step_cells"](spark, sf).collect()
    own = all_pairs({r.node_id: (r.x, r.y) for r in start.collect()})
    assert len(got) == len(want)
    for r in got:
        most = layout.LEGACY["damping"] * layout.LEGACY["repulsion"] * 0.05 * own[r.node_id][2]
        assert math.hypot(r.x - want[r.node_id].x, r.y - want[r.node_id].y) <= most + 1e-9
