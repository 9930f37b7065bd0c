"""What must not grow with the square of a graph, beside plain versions."""

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ringspark.functions import drawing
from ringspark.operators import candidates, contraction, cycles, distances, edits, layout, validate
from ringspark.operators.lineage import held
from ringspark.operators.model import batches, train

GRAPH = "graph_id string, u bigint, v bigint"


def test_girth_four_is_settled_by_rising_paths(spark, monkeypatch):
    """Graphs with a cycle of four send no root through all their paths; a triangle far from the hubs is found."""
    grid = [("grid", a, 100 + b) for a in range(6) for b in range(9)]
    hidden = [("hidden", a, b) for _, a, b in grid] + [("hidden", a, b) for a, b in ((200, 201), (201, 202), (200, 202), (200, 0), (201, 1), (202, 2))]
    rng = random.Random(1)
    mixed = [("mixed", *sorted(rng.sample(range(14), 2))) for _ in range(30)]
    roots, plain = [], contraction.search
    monkeypatch.setattr(contraction, "search", lambda ends, start, best: (roots.append({r.graph_id for r in start.collect()}), plain(ends, start, best))[1])
    got = {r.graph_id: r.girth for r in contraction.girths(spark.createDataFrame(grid + hidden + mixed, GRAPH)).collect()}
    want = cycles.shortest_cycle(cycles.of_edges(*map(list, zip(*(e[1:] for e in mixed), strict=True))))
    assert got == {"grid": 4, "hidden": 3, "mixed": want}
    assert "grid" in roots[0] and not roots[1] & {"grid", "hidden"}


def ring_of_rings(rng, graphs=6):
    """Graphs of paths, rings and chords, with ends of small degree."""
    rows = []
    for g in range(graphs):
        n = rng.randint(8, 24)
        rows += [(f"g{g}", i, i + 1) for i in range(n) if rng.random() < 0.8] + [(f"g{g}", *sorted(rng.sample(range(n + 1), 2))) for _ in range(n // 4)]
    return sorted(set(rows))


def counted(monkeypatch):
    """The labels of the tables that a contraction writes from now on."""
    labels, plain = [], contraction.held
    monkeypatch.setattr(contraction, "held", lambda df, label="round": (labels.append(label), plain(df, label))[1])
    return labels


def test_girth_levels_of_long_rings_takes_few_tables(spark, monkeypatch):
    """Rounds of tables grow with the longest ring; graphs that fit into a task have none, copies and loops do no harm."""
    from ringspark.plans import catalog

    n = 2000
    rows = [("ring", i, (i + 1) % n) for i in range(n)] + [("path", i, i + 1) for i in range(n)] + [("loop", 0, 1), ("loop", 1, 1), ("twice", 0, 1), ("twice", 1, 0)]
    rows += [("theta", *e) for k in (3, 400, 7) for e in zip([0, *range(10 * k, 10 * k + k - 1)], [*range(10 * k, 10 * k + k - 1), 1], strict=True)]
    monkeypatch.setattr(catalog, "t", lambda spark, sf_dir: (None, spark.createDataFrame(rows, GRAPH)))
    labels = counted(monkeypatch)
    assert {r.graph_id: r.girth for r in catalog.QUERIES["girth_levels"](spark, "").collect()} == {"ring": n, "theta": 10, "loop": 1}
    assert len(labels) < 10


def test_graphs_leave_the_tables_once_they_fit(spark, monkeypatch):
    """Some fit at first, some after a round, and a core that no task searches goes back to the tables."""
    rows = ring_of_rings(random.Random(3), 20) + [("long", i, (i + 1) % 300) for i in range(300)] + [("grid", a, 100 + b) for a in range(6) for b in range(9)]
    want = {}
    for name in {e[0] for e in rows}:
        if found := cycles.shortest_cycle(cycles.of_edges(*map(list, zip(*(e[1:] for e in rows if e[0] == name), strict=True)))):
            want[name] = found
    monkeypatch.setattr(contraction, "CORE", 15)
    searched, plain = [], contraction.search
    monkeypatch.setattr(contraction, "search", lambda ends, start, best: (searched.append({r.graph_id for r in start.collect()}), plain(ends, start, best))[1])
    labels = counted(monkeypatch)
    assert {r.graph_id: r.girth for r in contraction.girths(spark.createDataFrame(rows, GRAPH), 60).collect()} == want
    assert searched and "grid" in searched[0] and "long" not in searched[0]
    assert 0 < labels.count("thin") < 12 and "left" in labels


def safe_by_search(edges, k, g):
    """(graph_id, u, v): distance of every safe pair, by plain searches."""
    out = {}
    for name in {e[0] for e in edges}:
        near = cycles.of_edges(*map(list, zip(*(e[1:] for e in edges if e[0] == name), strict=True)))
        low = sorted(v for v, own in near.items() if len(own) < k)
        for u in low:
            dist, queue = {u: 0}, [u]
            for x in queue:
                for y in near[x]:
                    if y not in dist:
                        dist[y] = dist[x] + 1
                        queue.append(y)
            out |= {(name, u, v): dist.get(v) for v in low if v > u and dist.get(v, 99) > g - 2}
    return out


def test_pairs_are_listed_by_blocks_and_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(candidates, "BLOCK", 5)
    rows = ring_of_rings(random.Random(2))
    edges = spark.createDataFrame(rows, GRAPH)
    vertices = edges.select("graph_id", F.explode(F.array("u", "v")).alias("node_id")).distinct()
    safe = candidates.safe_pairs(vertices, edges, 3, 5)
    want = safe_by_search(rows, 3, 5)
    assert sorted((r.graph_id, r.u, r.v) for r in safe.collect()) == sorted(want)
    open_ = candidates.pairs(vertices, edges, 3)
    assert sorted((r.graph_id, r.u, r.v) for r in open_.collect()) == sorted(safe_by_search(rows, 3, 3))
    # what lists the pairs is the last step: nothing shuffles, sorts or writes them
    plan = open_._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("RepartitionByExpression") and "LeftAnti" not in plan


def test_what_pairs_share_is_known_before_they_are_listed(spark, monkeypatch):
    """Scores are made and rounded for two degrees, not for two vertices."""
    monkeypatch.setattr(candidates, "BLOCK", 5)
    rows = ring_of_rings(random.Random(7))
    edges = spark.createDataFrame(rows, GRAPH)
    vertices = edges.select("graph_id", F.explode(F.array("u", "v")).alias("node_id")).distinct()
    want = sorted(safe_by_search(rows, 3, 6))
    goals = vertices.select("graph_id").distinct().select("graph_id", F.lit(3).alias("k"), F.lit(6).alias("g"))
    figures = held(validate.figures(vertices, edges, goals), "figures")
    every = candidates.scored_edges(vertices, edges, 3, 6, figures, digits=9)
    assert sorted((r.graph_id, r.u, r.v) for r in every.collect()) == want
    plan = every._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(vs") < plan.index("Join Inner")
    assert "round(" not in plan[: plan.index("Generate explode(vs")]


def test_a_vertex_meets_a_block_as_one_row(spark, monkeypatch):
    monkeypatch.setattr(candidates, "BLOCK", 5)
    rows = ring_of_rings(random.Random(8))
    edges = spark.createDataFrame(rows, GRAPH)
    vertices = edges.select("graph_id", F.explode(F.array("u", "v")).alias("node_id")).distinct()
    for few in (0, 1, 32):
        monkeypatch.setattr(candidates, "FEW", few)
        found = candidates.safe_pairs(vertices, edges, 3, 6)
        assert sorted((r.graph_id, r.u, r.v) for r in found.collect()) == sorted(safe_by_search(rows, 3, 6))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate explode(vs") < plan.index("Join Inner")


def test_least_drawn_without_a_hit(spark):
    rows = ring_of_rings(random.Random(3))
    edges = spark.createDataFrame(rows, GRAPH)
    vertices = edges.select("graph_id", F.explode(F.array("u", "v")).alias("node_id")).distinct()
    low = candidates.low_blocks(vertices, edges, 3)
    close = candidates.barred(distances.within(edges, low, 3), 5)
    want = {tuple(r) for r in edits.one_each(candidates.safe_pairs(vertices, edges, 3, 5).select("graph_id", "u", "v"), ["u", "v"], 4).collect()}
    for hits in (1e-9, 1, 64):
        assert {tuple(r) for r in candidates.least_drawn(low, close, 4, hits).collect()} == want


def test_draws_of_pairs_in_arrays_are_md5(spark):
    """The least draw of two arrays for ids and prefixes of any length, with and without pairs left out; no pair is a row."""
    rng = random.Random(1)
    own = lambda n: np.array(sorted({rng.randrange(-50, 10 ** rng.randint(1, 18)) for _ in range(n)}))
    for prefix in ("4:2024-01-01 00:", "0:" + "x" * 70 + "\u00e9:", "4:" + "y" * 44 + ":", "4:" + "y" * 53 + ":"):
        us = own(9)
        vs = np.union1d(own(12), us[:4])
        draw = lambda u, v: int(hashlib.md5(f"{prefix}{u}:{v}".encode()).hexdigest()[:8], 16)  # noqa: B023, E731
        every = sorted((draw(u, v), u, v) for u in us.tolist() for v in vs.tolist() if u < v)
        for gone in (0, 3, len(every)):
            not_u, not_v = (np.array([x[i] for x in every[:gone]], np.int64) for i in (1, 2))
            for at_once in (1, 64, 9999):
                assert drawing.least(prefix, us, vs, not_u, not_v, at_once) == (every[gone] if gone < len(every) else None)
    low = spark.createDataFrame([("g", i, 0, i // 8, 2) for i in range(24)], "graph_id string, node_id long, degree long, block int, last int")
    found = candidates.least_drawn(low, low.limit(0).selectExpr("graph_id", "node_id u", "node_id v", "0 distance"), 4)
    assert "Generate explode(vs" not in found._jdf.queryExecution().optimizedPlan().toString() and "md5" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("g", *min((int(hashlib.md5(f"4:g:{u}:{v}".encode()).hexdigest()[:8], 16), u, v) for v in range(24) for u in range(v))[1:])]


def test_the_last_pair_of_each_kind_is_the_best(spark):
    """Without the pairs, the same choice as among all of them, for girths under, at and over the goal."""
    rows = ring_of_rings(random.Random(5), 12)
    edges = spark.createDataFrame(rows, GRAPH)
    vertices = edges.select("graph_id", F.explode(F.array("u", "v")).alias("node_id")).distinct()
    goals = vertices.select("graph_id").distinct().select("graph_id", F.lit(3).alias("k"), F.element_at(F.array(F.lit(5), F.lit(7), F.lit(9)), (F.crc32("graph_id") % 3 + 1).cast("int")).alias("g"))
    figures = held(validate.figures(vertices, edges, goals), "figures")
    best = lambda found: {tuple(r) for r in candidates.greedy(found.withColumn("type", F.lit("add_edge")).withColumn("score", F.round("score", 9))).select("graph_id", "u", "v", "score").collect()}
    every = candidates.scored_edges(vertices, edges, 3, 5, figures)
    assert every.count() == len(safe_by_search(rows, 3, 5))
    assert best(candidates.last_edges(vertices, edges, 3, 5, figures)) == best(every)


def test_steps_of_a_layout_list_no_pairs(spark, monkeypatch):
    """Blocks of places against each other give the sums over all pairs, and only they are rows."""
    monkeypatch.setattr(layout, "BLOCK", 16)
    monkeypatch.setattr(layout, "STRIP", 5)
    rng = random.Random(4)
    rows = [(g, i, rng.uniform(-w, w), rng.uniform(-w, w), False) for g, w in (("near", 300.0), ("wide", 4000.0)) for i in range(70)]
    rows += [("near", 100 + i, 7.0, 7.0, False) for i in range(3)]
    positions = spark.createDataFrame(rows, "graph_id string, node_id long, x double, y double, fixed boolean")
    edges = spark.createDataFrame([(g, i, j) for g in ("near", "wide") for i, j in (rng.sample(range(70), 2) for _ in range(90))], GRAPH)
    for reach, pull in ((900.0, lambda d: 0.1 * (d - 300)), (None, lambda d: -3000.0 / (d * d))):
        met = layout.apart(positions).filter(f"d <= {reach or 1e9}")
        want = {(r.graph_id, r.node_id): (r.fx, r.fy) for r in layout.summed(met.withColumn("f", pull(F.col("d")))).collect()}
        got = {}
        for r in layout.against(positions, pull, reach).collect():
            a, b = got.get((r.graph_id, r.node_id), (0.0, 0.0))
            got[r.graph_id, r.node_id] = (a + r.fx, b + r.fy)
        for key, (a, b) in got.items():
            assert abs(a - want.get(key, (0, 0))[0]) < 1e-7 and abs(b - want.get(key, (0, 0))[1]) < 1e-7
    for step in (layout.spring_step, layout.legacy_step):
        monkeypatch.setattr(layout, "apart", None)
        monkeypatch.setattr(layout, "nearby", None)
        assert step(positions, edges).count() == len(rows)


def test_pairs_of_a_layout_are_reckoned_once(spark, monkeypatch):
    """For both of their ends, and of two blocks one row; what is out of reach of a strip is left out before."""
    monkeypatch.setattr(layout, "BLOCK", 30)
    monkeypatch.setattr(layout, "STRIP", 4)
    rng = random.Random(6)
    rows = [(g, i, rng.uniform(-w, w), rng.uniform(-10, 10), False) for g, w in (("near", 300.0), ("long", 40000.0)) for i in range(100)]
    positions = spark.createDataFrame(rows, "graph_id string, node_id long, x double, y double, fixed boolean")
    for reach, share in ((900.0, lambda d: 0.1 - 30.0 / d), (None, lambda d: -3000.0 / d**3)):
        seen = spark.sparkContext.accumulator(0)

        def counted(d, share=share, seen=seen):
            seen.add(d.size)
            return share(d)

        got = {}
        for r in layout.against(positions, None, reach, counted).collect():
            a, b = got.get((r.graph_id, r.node_id), (0.0, 0.0))
            got[r.graph_id, r.node_id] = (a + r.fx, b + r.fy)
        for g, i, x, y, _ in rows:
            ways = [(u - x, v - y) for h, j, u, v, _ in rows if h == g and j != i]
            ways = [(u, v, np.hypot(u, v)) for u, v in ways if 0.1 <= np.hypot(u, v) <= (reach or 1e9)]
            want = [sum(share(d) * w[c] for *w, d in ways) for c in (0, 1)]
            assert np.allclose(got.get((g, i), (0.0, 0.0)), want, rtol=1e-9, atol=1e-7)
        pairs = 2 * 100 * 99 / 2
        assert seen.value < 1.1 * pairs if reach is None else seen.value < 0.7 * pairs


def test_gradient_of_a_large_graph_has_no_dense_adjacency(spark, monkeypatch):
    n = 300
    edges = spark.createDataFrame([("g", i, i + 1) for i in range(n)] + [("g", 0, 0), ("g", 5, 90)], GRAPH)
    vertices = spark.createDataFrame([("g", i) for i in range(n + 2)] + [("lone", 1)], "graph_id string, node_id long")
    graphs, layers = batches.graph_rows(vertices, edges), train.start(4, np.random.default_rng(0))
    want = sum(batches.contribution(layers, r.graph_id, batches.arrays(r.nodes, r.steps), 2) for r in graphs.collect())
    r = graphs.filter("graph_id = 'g'").collect()[0]
    monkeypatch.setattr(batches, "arrays", None)
    got = {x.place: x.value for x in batches.summed(graphs, layers, 2).collect()}
    assert np.allclose([got[i] for i in range(len(want))], want, rtol=0, atol=1e-9)
    row = pa.array([r.asDict(True)["nodes"]])[0].values, pa.array([r.asDict(True)["steps"]])[0].values
    a = batches.sparse(*row)[0]
    assert max(len(v) for v in vars(a).values() if isinstance(v, np.ndarray)) <= 2 * (n + 2)
