"""Searches reach known graphs; the model learns; sessions run as a stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringspark.operators import history, search, trees
from ringspark.operators.model import layers, train
from ringspark.operators.search.methods import METHODS, RandomWalk, method
from ringspark.operators.search.runner import best_of_walkers, run, targets
from ringspark.sources import projections
from ringspark.streaming import session


def test_small_cages_are_found(spark):
    found = run(targets(spark, "small").filter("k = 3"), ["bruteforce", "astar"], max_steps=600).collect()
    assert {(r["k"], r["g"]) for r in found if r["success"]} == {(3, 5), (3, 6)}
    for r in found:
        if r["success"]:
            degree = np.bincount([x for e in r["edges"] for x in (e["u"], e["v"])])
            assert (degree == 3).all() and r["final_girth"] == r["g"]


def test_walkers_and_summary(spark):
    found = run(targets(spark, "small").filter("g = 5 and k = 3"), ["randomwalk", "mcts"], max_steps=200, walkers=3)
    found = found.cache()
    assert found.count() == 6 and best_of_walkers(found).count() == 2
    assert {r["generator"]: r["runs"] for r in search.summary(found).collect()} == {"randomwalk": 3, "mcts": 3}


def test_searches_repeat_by_seed():
    for cls in METHODS.values():
        a, b = cls(3, 5, 4), cls(3, 5, 4)
        for _ in range(40):
            a.step(), b.step()
        assert a.graph.edges() == b.graph.edges()
    assert method("no such") is RandomWalk
    with pytest.raises(ValueError):
        RandomWalk(1, 5)


def test_any_class_can_be_run(spark):
    class Broken:
        def __init__(self, k, g, seed):
            raise RuntimeError("no")

    (r,) = run(targets(spark, "small").limit(1), ["mine"], makers={"mine": Broken}).collect()
    assert not r["success"] and r["error"] == "RuntimeError: no"


def test_gradients():
    rng = np.random.default_rng(0)
    own = train.start(5, rng)
    a, x, y = train.sample(rng)
    p, tape = train.forward(own, a, x, np.random.default_rng(1))
    grads = train.gradients(own, a, tape, 2 * (p - y) / len(y))
    loss = lambda: ((train.forward(own, a, x, np.random.default_rng(1))[0] - y) ** 2).mean()
    for i, name, at in ((0, "near", (1, 2)), (1, "own", (0, 3)), (2, "scale", (4,)), (3, "bias", (0,))):
        old, eps = own[i][name][at], 1e-6
        own[i][name][at] = old + eps
        up = loss()
        own[i][name][at] = old - eps
        down = loss()
        own[i][name][at] = old
        assert np.isclose((up - down) / (2 * eps), grads[i][name][at], rtol=1e-3, atol=1e-5)


def test_model_learns_and_travels(spark, tmp_path):
    model, figures = train.train(epochs=300, hidden=32, evaluate_every=20)
    assert figures["metrics"]["mean_absolute_error"] < 1.5
    layers.save_weights(spark, model, str(tmp_path / "w"))
    back = layers.load_weights(spark, str(tmp_path / "w"))
    vertices, edges = projections.random_graphs(spark.range(4))
    rows = layers.features(vertices).cache()
    got = {(r["graph_id"], r["node_id"]): r["score"] for r in layers.forward(rows, edges, back).collect()}
    nodes = {}
    for r in rows.collect():
        nodes.setdefault(r["graph_id"], {})[r["node_id"]] = r["features"]
    for g, own in nodes.items():
        a = np.zeros((len(own), len(own)))
        for e in edges.filter(F.col("graph_id") == g).collect():
            a[e["u"], e["v"]] += 1
            a[e["v"], e["u"]] += 1
        want, _ = train.forward([{k: np.array(v) for k, v in x.items()} for x in model["layers"]], a, np.array([own[i] for i in range(len(own))]))
        assert np.allclose([got[g, i] for i in range(len(own))], want, atol=1e-8)
    predictions = layers.predict(vertices, edges, layers.forward(rows, edges, back))
    assert layers.attach(vertices, predictions).filter("is_wrong is null").count() == 0


def test_reports(spark):
    rows = spark.createDataFrame([(1, 50.0, 1.0), (2, 80.0, 0.5), (3, 80.0, 0.4), (4, 70.0, 0.1)], "epoch int, accuracy double, mae double")
    assert history.best_epoch(rows).first()["epoch"] == 3
    tree = spark.createDataFrame([(0, None), (1, 0), (2, 1)], "node int, parent int")
    got = trees.propagate(tree, spark.createDataFrame([(2, 1.0), (1, 0.5)], "node int, reward double"))
    assert {r["node"]: (r["visits"], r["value"]) for r in got.collect()} == {0: (2, 1.5), 1: (2, 1.5), 2: (1, 1.0)}


def test_sessions_as_a_stream(spark, tmp_path):
    schema = "session_id string, kind string, k int, g int, generator string"
    rows = [("a", "start", 3, 5, "bruteforce"), ("a", "poll", None, None, None), ("b", "start", 3, 6, "randomwalk"), ("b", "stop", None, None, None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # timers alone start no batch
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    query = session.run(stream, steps=50).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(100), "still running"
    found = spark.table("sessions").collect()
    assert {(r["session_id"], r["stopped"]) for r in found} == {("a", False), ("b", False), ("b", True)}
    assert any(r["success"] for r in found if r["session_id"] == "a")
    assert all(r["moore_bound"] == {5: 10, 6: 14}[r["g"]] for r in found)


def test_session_tables(spark):
    own = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:04"), ("b", "2024-01-01 00:00:01")], "s string, t string").withColumn("t", F.to_timestamp("t"))
    now = F.to_timestamp(F.lit("2024-01-01 00:00:08"))
    assert [r["session"] if "session" in r else r["s"] for r in session.abandoned(own, "s", "t", now).collect()] == ["b"]
    assert sorted((r["s"], r["gap"]) for r in session.gaps(own, "s", "t").collect() if r["gap"]) == [("a", 4.0)]
    assert session.windows(own, "s", "t", "5 seconds").count() == 2
    kept = spark.createDataFrame([("a", True), ("b", False)], "s string, stopped boolean").withColumn("last", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    assert [r["s"] for r in session.evicted(kept, F.to_timestamp(F.lit("2024-01-01 00:01:00"))).collect()] == ["a"]


def test_search_queries_run_all_targets_with_all_steps(spark):
    from ringspark.plans import catalog
    from ringspark.schema import MAX_STEPS, TARGETS

    found = catalog.QUERIES["search_dfs"](spark, "").collect()
    assert sorted((r["k"], r["g"]) for r in found) == sorted((k, g) for _, k, g, _, _ in TARGETS)
    assert all(r["success"] or r["steps"] == MAX_STEPS for r in found)


def test_dropout_is_seeded_and_keeps_the_mean(spark):
    rows = spark.range(4000).select(F.lit("g").alias("graph_id"), F.col("id").alias("node_id"), F.array(F.lit(1.0), F.lit(-2.0)).alias("features"))
    one, two = (sorted(map(tuple, layers.dropout(rows, 0.25, 2, seed=3).collect())) for _ in range(2))
    assert one == two and {x for r in one for x in r[2]} == {0.0, 1 / 0.75, -2 / 0.75}
    assert abs(sum(r[2][0] for r in one) / 4000 - 1) < 0.05 and any((r[2][0] == 0) != (r[2][1] == 0) for r in one)
    assert [tuple(r) for r in layers.dropout(rows, 0.0, 2).limit(3).collect()] == [tuple(r) for r in rows.limit(3).collect()]
    with pytest.raises(ValueError, match="share of dropped"):
        layers.dropout(rows, 1.0, 2)
