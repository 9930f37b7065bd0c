"""Gradients over tables of graphs beside those of one process."""

import numpy as np

from ringspark.operators.model import batches, train
from ringspark.sources import projections

SF = "/root/testdata/sf0.001"


def test_gradient_equals_one_process(spark):
    graphs = batches.graph_rows(*projections.hours(spark, SF)).repartition(5)
    layers = train.start(6, np.random.default_rng(0))
    n, loss, grads, change = batches.gradient(graphs, layers, seed=3)
    rows = graphs.collect()
    each = np.array([batches.contribution(layers, r.graph_id, batches.arrays(r.nodes, r.steps), 3) for r in rows])
    assert n == len(rows) > 100
    want = each.mean(0)[1:]
    got = np.concatenate([[loss], batches.flat(grads, batches.GRADIENTS), batches.flat(change, batches.STATISTICS)])
    assert np.allclose(got, want, rtol=0, atol=1e-9)
    # what one graph gives is the hand-written gradient of training in one process
    r, rng = rows[0], np.random.default_rng([3, batches.crc32(rows[0].graph_id.encode())])
    a, x, y = batches.arrays(r.nodes, r.steps)
    assert (a.sum(1) == y).all()
    own = [{k: v.copy() for k, v in layer.items()} for layer in layers]
    p, tape = train.forward(own, a, x, rng)
    assert np.allclose(batches.flat(train.gradients(own, a, tape, 2 * (p - y) / len(y)), batches.GRADIENTS), each[0][2 : 2 + batches.flat(layers, batches.GRADIENTS).size])


def test_loss_falls(spark):
    graphs = batches.graph_rows(*projections.hours(spark, SF))
    model, losses = batches.fit(graphs, epochs=12, hidden=8, rate=0.05)
    assert len(losses) == 12 and losses[-1] < 0.8 * losses[0]
    assert [len(x["bias"]) for x in model["layers"]] == [8, 8, 8, 1]


def test_no_graphs(spark):
    none = projections.hours(spark, SF)
    graphs = batches.graph_rows(none[0].limit(0), none[1].limit(0))
    n, loss, grads, _ = batches.gradient(graphs, train.start(3, np.random.default_rng(0)))
    assert (n, loss) == (0, 0.0) and not any(v.any() for layer in grads for v in layer.values())
    assert batches.fit(graphs, epochs=3)[1] == []


def test_query_is_the_sum_over_graphs(spark):
    from ringspark.plans import catalog, details  # noqa: F401

    got = {r.place: r.value for r in catalog.QUERIES["training_gradient"](spark, SF).collect()}
    layers = train.start(8, np.random.default_rng(0))
    rows = batches.graph_rows(*projections.hours(spark, SF)).collect()
    want = sum(batches.contribution(layers, r.graph_id, batches.arrays(r.nodes, r.steps), 0) for r in rows)
    assert sorted(got) == list(range(len(want))) and np.allclose([got[i] for i in range(len(want))], want, rtol=0, atol=1e-5)
