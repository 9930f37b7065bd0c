"""Named graphs with known figures, edge lists, edits and properties."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ringspark.functions import basic, bounds
from ringspark.operators import candidates, cycles, edits, fingerprint, layout, metrics, validate
from ringspark.schema import TARGETS
from ringspark.sources import edge_lists, projections


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def texts(spark, *own):
    return spark.createDataFrame(list(own), "graph_id string, text string")


def test_bounds_of_the_targets(spark):
    assert [bounds.moore(k, g) for _, k, g, _, _ in TARGETS] == [10, 14, 17, 22, 30, 26, 46, 26]
    assert all(bounds.moore(k, g) <= known <= bounds.upper(k, g) for _, k, g, _, known in TARGETS)
    with pytest.raises(ValueError):
        bounds.moore(1, 5)
    own = spark.createDataFrame([(k, g) for k in range(2, 7) for g in range(3, 11)], "k int, g int")
    found = own.select("k", "g", bounds.moore_column(F.col("k"), F.col("g")).alias("m"), bounds.upper_column(F.col("k"), F.col("g")).alias("u")).collect()
    assert all((r["m"], r["u"]) == (bounds.moore(r["k"], r["g"]), bounds.upper(r["k"], r["g"])) for r in found)


def test_gold_girths_both_ways(spark):
    vertices, edges = projections.gold(spark)
    want = {"petersen": 5, "heawood": 6, "c8": 8, "k4": 3, "path": None, "loop": 1}
    assert dict(rows_none(cycles.girth(vertices, edges))) == want
    assert dict(rows_none(cycles.girth(vertices, edges, small=0))) == want


def test_hand_off_query_gives_every_girth(spark, monkeypatch):
    from ringspark.plans import catalog

    monkeypatch.setattr(catalog, "h", lambda spark, sf_dir: projections.gold(spark))
    assert dict(rows_none(catalog.QUERIES["girth_hand_off"](spark, ""))) == {"petersen": 5, "heawood": 6, "c8": 8, "k4": 3, "path": None, "loop": 1}


def rows_none(df):
    return [(r["graph_id"], r["girth"]) for r in df.collect()]


def test_empty_graph(spark):
    vertices, edges = projections.edgeless(spark.createDataFrame([("none", 0)], "graph_id string, n long"))
    goal = spark.createDataFrame([("none", 3, 5)], "graph_id string, k int, g int")
    (r,) = validate.validate(vertices, edges, goal).collect()
    assert (r["num_nodes"], r["num_edges"], r["girth"], r["is_k_regular"], r["is_valid_cage"]) == (0, 0, None, True, False)


@pytest.mark.parametrize(
    "name, text, nodes, edges",
    [("triangle", "0 1\n1 2\n2 0", 3, 3), ("isolated", "0 1\n1 2\n3", 4, 2), ("loop", "0 0\n0 1", 2, 2), ("duplicate", "0 1\n1 0\n0 1", 2, 1), ("blank", "\n0 1\n\n 2 \n", 3, 1), ("empty", "", 0, 0), ("signs", "-3 10", 2, 1)],
)
def test_both_parsers(spark, name, text, nodes, edges):
    for mode in ("strict", "permissive"):
        v, e = edge_lists.parse(texts(spark, (name, text)), mode)
        assert (v.count(), e.count()) == (nodes, edges)


def test_bad_lines(spark):
    for text in ("0 x", "0 1 2", "1.5 2"):
        with pytest.raises(PySparkException, match="line 1"):
            edge_lists.parse(texts(spark, ("bad", text)))[0].collect()
    v, e = edge_lists.parse(texts(spark, ("a", "0 x"), ("b", "0 1 2"), ("c", "12abc 3")), "permissive")
    assert rows(e, "graph_id", "u", "v") == [("b", 0, 1), ("c", 3, 12)]
    with pytest.raises(ValueError):
        edge_lists.parse(texts(spark), "other")


def test_loop_counts_two(spark):
    vertices, edges = edge_lists.parse(texts(spark, ("g", "0 0\n0 1")))
    assert rows(metrics.degrees(vertices, edges), "node_id", "degree") == [(0, 3), (1, 1)]
    assert rows(metrics.neighbor_counts(vertices, edges), "node_id", "neighbors") == [(0, 2), (1, 1)]


def test_json_and_requests(spark):
    v, e = edge_lists.parse_json(texts(spark, ("g", "[[1,2],[2,1],[5],[1,2,3],[]]")))
    assert rows(e, "u", "v") == [(1, 2)] and rows(v, "node_id") == [(1,), (2,), (5,)]
    asked = spark.createDataFrame([('{"k":3,"g":5}',)], "body string")
    assert edge_lists.requests(asked, "k int, g int", ["k", "g"]).first()["k"] == 3
    with pytest.raises(PySparkException, match="missing: g"):
        edge_lists.requests(spark.createDataFrame([('{"k":3}',)], "body string"), "k int, g int", ["k", "g"]).collect()


def test_model_info(spark, tmp_path):
    own = spark.createDataFrame([("t", 5, 64, 0.005, (0.123456, 0.2, 99.999), "p")], "last_updated string, epoch bigint, hidden_dim bigint, learning_rate double, metrics struct<mean_squared_error:double,mean_absolute_error:double,accuracy:double>, model_path string")
    edge_lists.write_model_info(own, str(tmp_path / "info"))
    back = edge_lists.read_model_info(spark, str(tmp_path / "info")).first()
    assert (back["metrics"]["mean_squared_error"], back["metrics"]["accuracy"]) == (0.1235, 100.0)


def test_ids(spark):
    own = spark.createDataFrame([("a", 0), ("a", 1), ("a", 3), ("b", -2), ("c", 5)], "graph_id string, node_id bigint")
    assert rows(metrics.next_ids(own), "graph_id", "after_max", "num_nodes", "smallest_free") == [("a", 4, 3, 2), ("b", -1, 1, 0), ("c", 6, 1, 0)]


def test_missing_vertex(spark):
    vertices, _ = projections.gold(spark)
    ask = spark.createDataFrame([("k4", 2)], "graph_id string, node_id bigint")
    assert metrics.require(vertices, ask).count() == 1
    with pytest.raises(PySparkException, match="no such vertex: 9"):
        metrics.require(vertices, spark.createDataFrame([("k4", 9)], "graph_id string, node_id bigint")).collect()


def test_toggle_twice_is_nothing(spark):
    _, edges = projections.gold(spark)
    pairs = spark.createDataFrame([("k4", 0, 1), ("c8", 0, 4)], "graph_id string, u bigint, v bigint")
    assert rows(edits.toggle(edits.toggle(edges, pairs), pairs), "graph_id", "u", "v") == rows(edges, "graph_id", "u", "v")


def test_random_edits_keep_the_tables_whole(spark):
    vertices, edges = projections.random_graphs(spark.range(10))
    v, e = edits.remove_random_vertex(vertices, edges)
    assert v.count() == vertices.count() - 10
    assert metrics.adjacency(e).join(v, (F.col("src") == F.col("node_id")) & (metrics.adjacency(e)["graph_id"] == v["graph_id"]), "left_anti").count() == 0
    full = metrics.degrees(vertices, edges).filter("degree > 2").select("graph_id").distinct().count()
    assert edits.remove_edge_above(vertices, edges, 2).count() == edges.count() - full


def test_degree_sum_is_twice_the_edges(spark):
    vertices, edges = projections.random_graphs(spark.range(30))
    assert metrics.degrees(vertices, edges).agg(F.sum("degree")).first()[0] == 2 * edges.count()


def test_safe_pairs_keep_the_girth(spark):
    vertices, edges = projections.random_graphs(spark.range(8), self_loop_prob=0.0)
    safe = candidates.girth_safe(candidates.pairs(vertices, edges, 4), edges, 5).select("graph_id", "u", "v")
    before = dict(rows_none(cycles.girth(vertices, edges)))
    adjacency = {}
    for r in edges.collect():
        adjacency.setdefault(r["graph_id"], []).append((r["u"], r["v"]))
    for r in safe.collect():
        own = [*adjacency.get(r["graph_id"], []), (r["u"], r["v"])]
        after = cycles.shortest_cycle(cycles.of_edges(*map(list, zip(*own, strict=True))))
        assert after is None or after >= min(5, before[r["graph_id"]] or 5)


def test_fingerprint_is_the_same_after_renaming(spark):
    vertices, edges = projections.gold(spark)
    name = {i: x for i, x in enumerate(random.Random(1).sample(range(100, 200), 20))}
    renamed = spark.createDataFrame([("p", min(name[r["u"]], name[r["v"]]), max(name[r["u"]], name[r["v"]])) for r in edges.filter("graph_id = 'petersen'").collect()], "graph_id string, u bigint, v bigint")
    nodes = spark.createDataFrame([("p", name[i]) for i in range(10)], "graph_id string, node_id bigint")
    prints = dict(rows(fingerprint.wl_hash(vertices, edges), "graph_id", "fingerprint"))
    assert fingerprint.wl_hash(nodes, renamed).first()["fingerprint"] == prints["petersen"] != prints["heawood"]


def test_print_and_parse(spark):
    vertices, edges = projections.random_graphs(spark.range(12))
    v, e = edge_lists.parse(edge_lists.print_lines(vertices, edges))
    assert rows(v, "graph_id", "node_id") == rows(vertices, "graph_id", "node_id")
    assert rows(e, "graph_id", "u", "v") == rows(edges, "graph_id", "u", "v")


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=14))
def test_girth_by_brute_force(pairs):
    own = {(min(p), max(p)) for p in pairs}
    near = cycles.of_edges([u for u, _ in own], [v for _, v in own])
    assert (cycles.shortest_cycle(near) or math.inf) == slow_girth(own)


def test_long_rings_and_random_graphs_by_brute_force():
    n = 20_001
    ring = cycles.of_edges(list(range(n)), [*range(1, n), 0])
    assert cycles.shortest_cycle(ring) == n
    rng = random.Random(3)
    for _ in range(300):
        size = rng.randint(3, 14)
        own = {(min(p), max(p)) for p in (rng.sample(range(size), 2) for _ in range(rng.randint(1, size + 3)))}
        near = cycles.of_edges([u for u, _ in own], [v for _, v in own])
        assert (cycles.shortest_cycle(near) or math.inf) == slow_girth(own)


def slow_girth(own):
    if any(u == v for u, v in own):
        return 1
    best = math.inf
    for u, v in own:
        level, seen, d = {u}, {u}, 0
        while level and v not in seen:
            d += 1
            level = {y for x in level for a, b in own - {(u, v)} for y in ((b,) if a == x else (a,) if b == x else ())} - seen
            seen |= level
        if v in seen:
            best = min(best, d + 1)
    return best


def test_numbers_and_formats(spark):
    own = spark.createDataFrame([("1",), ("+4",), ("-2",), ("1.5",), ("1_0",), ("12ab",), ("99999999999999999999",)], "t string")
    found = own.select(basic.strict_int(F.col("t")).alias("s"), basic.lenient_int(F.col("t")).alias("l")).collect()
    assert [r["s"] for r in found] == [1, 4, -2, None, None, None, None]
    assert [r["l"] for r in found] == [1, 4, -2, 1, 1, 12, None]
    halves = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-3.0,)], "x double")
    assert [r[0] for r in halves.select(basic.round_half_even_nonnegative(F.col("x"))).collect()] == [0.0, 2.0, 2.0, 0.0]
    times = spark.createDataFrame([(0.25,), (12.34,), (75.0,)], "s double")
    assert [r[0] for r in times.select(basic.duration(F.col("s"))).collect()] == ["250ms", "12.3s", "1m 15s"]


def test_layout_settles(spark):
    vertices, edges = projections.gold(spark)
    start = layout.circle(vertices).withColumn("fixed", F.col("node_id") == 0)
    after = layout.settle(start, edges, steps=3, every=1)
    fixed = lambda df: rows(df.filter("fixed"), "graph_id", "x", "y")
    assert fixed(after) == fixed(start) and after.count() == start.count()
