"""Settings, the command line, documents, deep trees and single edits."""

import json
import random

import pytest

from ringspark import cli, config
from ringspark.operators import candidates, edits, history, layout
from ringspark.operators.model import layers
from ringspark.operators.search import methods, runner
from ringspark.sources import edge_lists


def test_settings_come_from_the_environment():
    assert config.read({}) == config.Config()
    own = config.read({"RINGSPARK_MIN_NODES": "7", "RINGSPARK_MAX_PROB": "0.5", "RINGSPARK_DEBUG": "True", "OTHER": "1"})
    assert (own.min_nodes, own.max_prob, own.debug, own.epochs) == (7, 0.5, True, 5000)
    with pytest.raises(ValueError):
        config.read({"RINGSPARK_EPOCHS": "many"})


def test_command_line(spark):
    lines = cli.main(["--suite", "small", "--generator", "bruteforce", "--max-steps", "40", "--verbose"], spark)
    assert len(lines) == 4 and lines[-1].startswith("bruteforce: ")
    with pytest.raises(SystemExit):
        cli.options(["--suite", "huge"])
    assert runner.preset(spark, "all").count() == 8
    with pytest.raises(ValueError):
        runner.preset(spark, "huge")


def test_documents_are_written_one_to_a_line(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, None, 3.5)], "id long, name string, girth double")
    edge_lists.write_documents(rows, "id", f"file://{tmp_path}/out")
    found = [json.loads(r.value) for r in spark.read.text(f"file://{tmp_path}/out").collect()]
    assert sorted(found, key=str) == sorted([{"name": "a", "girth": None}, {"name": None, "girth": 3.5}], key=str)


def test_running_best_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(i, rng.random() + i / 500) for i in range(500)]
    found = history.running_best(spark.createDataFrame(rows, "at long, value double").repartition(5), "at", "value")
    best = None
    for r in sorted(found.collect(), key=lambda r: r["at"]):
        assert r["best_before"] == best and r["is_best"] == (best is None or r["value"] > best)
        best = r["value"] if best is None else max(best, r["value"])


def test_a_vertex_over_the_degree_loses_one_edge(spark):
    star = [("s", 0, i) for i in range(1, 6)] + [("s", 1, 2)]
    vertices = spark.createDataFrame([("s", i) for i in range(6)], "graph_id string, node_id long")
    edges = spark.createDataFrame(star, "graph_id string, u long, v long")
    for seed in range(4):
        left = {tuple(r) for r in edits.remove_edge_above(vertices, edges, 3, seed).collect()}
        gone = set(star) - left
        assert len(gone) == 1 and all(u == 0 for _, u, v in gone)
    assert edits.remove_edge_above(vertices, edges, 5).count() == 6


def test_springs_by_cells_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = [("g", i, rng.uniform(-3000, 3000), rng.uniform(-3000, 3000), False) for i in range(60)]
    positions = spark.createDataFrame(rows, "graph_id string, node_id long, x double, y double, fixed boolean")
    pairs = lambda df: {(r.src, r.dst) for r in df.collect()}
    assert pairs(layout.nearby(positions, 900.0)) == pairs(layout.apart(positions).filter("d <= 900"))


def test_weights_are_read_once(spark, tmp_path):
    path = f"file://{tmp_path}/weights"
    layers.save_weights(spark, {"layers": [{"near": [[1.0]], "own": [[2.0]], "bias": [0.5]}]}, path)
    first = layers.cached_weights(spark, path)
    assert first["layers"][0]["own"] == [[2.0]] and layers.cached_weights(spark, path) is first


def test_tree_search_edits_and_moves_its_root():
    search = methods.TreeSearch(3, 5, seed=4)
    scores = []
    for _ in range(200):
        before = search.root
        search.step()
        if search.root is not before:
            scores.append(search.score(search.root.graph) - search.score(before.graph))
    assert scores and min(scores) > 0 and search.root.parent is None
    graph = methods.Graph(4)
    for _ in range(300):
        search.edit(graph)
        assert all(len(s) <= 3 for s in graph.near.values()) and (graph.girth() >= 5)


def test_best_first_counts_states(spark):
    search = methods.BestFirst(3, 5)
    while not search.is_complete:
        search.step()
    assert search.success and search.explored == search.step_count and search.duplicates >= 0
    found = runner.run(runner.targets(spark, "small"), ["astar", "randomwalk"], max_steps=5).collect()
    assert {(r.generator, r.explored) for r in found} == {("astar", 5), ("randomwalk", None)}


def test_mean_best_without_visits(spark):
    rows = spark.createDataFrame([(1, 10, 0, 0.0), (1, 11, 2, 1.0), (2, 20, 0, 0.0), (2, 21, 0, 0.0)], "parent long, child long, visits long, value double")
    assert {tuple(r) for r in candidates.best_mean(rows).collect()} == {(1, 11), (2, 20)}
