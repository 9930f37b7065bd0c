"""Queries of requests, sessions, histories and single edits, each beside its SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ringspark.functions import basic, bounds
from ringspark.operators import candidates, distances, edits, fingerprint, history, layout, metrics, multisets, repulsion, validate
from ringspark.operators.lineage import held, shared_dir
from ringspark.operators.model import batches, layers, train
from ringspark.operators.search import frontier, runner
from ringspark.schema import RANDOM_GRAPH, TARGETS
from ringspark.sources import edge_lists, projections, sinks
from ringspark.streaming import lifetimes, session

from . import sql
from .catalog import ASKED, FIGURES, PLACED, SAFE, SIMPLE, TURN, G, K, asked, guessed, h, query, r, rounded_places, simple, t, wanted
from .sql import graph

GENERATORS = ["randomwalk", "bruteforce", "astar", "mcts"]


def drawn(*parts: str) -> str:
    return sql.uniform(f"concat_ws(':', {', '.join(parts)})")


# --- indexes and lookups ----------------------------------------------------------------

INDEX = f"{graph('h')}, i AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS idx, count(*) OVER (PARTITION BY graph_id) AS n FROM h_v)"


@query(f"WITH {INDEX} SELECT e.graph_id, e.u, e.v, a.idx AS u_idx, b.idx AS v_idx FROM h_e e JOIN i a ON a.graph_id = e.graph_id AND a.node_id = e.u JOIN i b ON b.graph_id = e.graph_id AND b.node_id = e.v")
def edge_index(spark, sf_dir):
    return metrics.indexed_edges(*h(spark, sf_dir))


@query(f"WITH {graph('h')} SELECT graph_id, u, v FROM h_e WHERE u % 2 = 0 AND v % 2 = 0")
def matched_edges(spark, sf_dir):
    vertices, edges = h(spark, sf_dir)
    return edge_lists.matched(edge_lists.print_lines(vertices, edges), vertices.filter("node_id % 2 = 0"))


@query(f"WITH {graph('h')}, x AS (SELECT graph_id, min(node_id) AS node_id FROM h_v GROUP BY graph_id) SELECT d.graph_id, d.node_id, d.degree AS true_degree, d.degree::DOUBLE AS predicted_degree FROM h_d d JOIN x USING (graph_id, node_id)")
def predict_one(spark, sf_dir):
    vertices, edges = h(spark, sf_dir)
    return layers.predict_some(vertices, edges, vertices.groupBy("graph_id").agg(F.min("node_id").alias("node_id")))


@query(f"WITH {graph('h')}, x AS (SELECT graph_id, max(node_id) AS node_id FROM h_v GROUP BY graph_id) SELECT * FROM x")
def guarded_vertices(spark, sf_dir):
    vertices = h(spark, sf_dir)[0]
    return metrics.require(vertices, vertices.groupBy("graph_id").agg(F.max("node_id").alias("node_id")))


@query(f"WITH {graph('t')} SELECT graph_id, src AS node_id, list_contains(near, 1) AS has_one, coalesce(list_position(near, 1), 0)::BIGINT AS place, array_to_string([x FOR x IN near IF x <> 1], ',') AS others FROM (SELECT graph_id, src, list(DISTINCT dst ORDER BY dst) AS near FROM t_a GROUP BY ALL)")
def neighbor_edit(spark, sf_dir):
    near, one = F.col("neighbors"), F.lit(1).cast("bigint")
    lists = metrics.neighbor_lists(t(spark, sf_dir)[1])
    return lists.select("graph_id", "node_id", F.array_contains(near, one).alias("has_one"), F.array_position(near, one).alias("place"), F.array_join(F.array_remove(near, one).cast("array<string>"), ",").alias("others"))


# --- sources and documents --------------------------------------------------------------


@query(f"WITH {graph('r')}, i AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS idx, count(*) OVER (PARTITION BY graph_id) AS n FROM r_v) SELECT graph_id, node_id, round(idx / greatest(n - 1, 1)::DOUBLE, 9) AS norm, 4 AS width, degree::DOUBLE AS label FROM i JOIN r_d USING (graph_id, node_id)")
def training_sample(spark, sf_dir):
    rows, _ = layers.training_rows(*r(spark, sf_dir))
    return rows.select("graph_id", "node_id", F.round(F.col("features")[0], 9).alias("norm"), F.size("features").alias("width"), "label")


@query()
def training_gradient(spark, sf_dir):
    """Gradients, loss and running statistics of a first step over all hours' graphs, added up by Spark."""
    start = train.start(8, np.random.default_rng(0))
    return batches.summed(batches.graph_rows(*t(spark, sf_dir)), start, 0).select("place", F.round("value", 6).alias("value"))


@query(f"""WITH {ASKED}, p AS (SELECT k, g, [(k - 1) ** i FOR i IN range(0, 12)] AS w FROM a WHERE k BETWEEN 2 AND 4 AND g >= 3),
    m AS (SELECT k, g, (CASE WHEN g % 2 = 1 THEN 1 + k * list_sum(w[1:(g - 1) // 2]) ELSE 2 * list_sum(w[1:g // 2]) END)::BIGINT AS n FROM p)
    SELECT s_suppkey::VARCHAR AS graph_id, n AS num_nodes, 0::BIGINT AS num_edges FROM supplier JOIN m ON k = s_suppkey % 3 + 2 AND g = s_nationkey % 7 + 3""")
def edgeless_moore(spark, sf_dir):
    """For each supplier the graph without edges that a search for its k and g starts from."""
    k, g = F.col("k"), F.col("g")
    goals = asked(spark, sf_dir).filter(bounds.valid_column(k, g) & (k <= 4))
    own = projections.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("graph_id"), (F.col("s_suppkey") % 3 + 2).cast("int").alias("k"), (F.col("s_nationkey") % 7 + 3).cast("int").alias("g"))
    return metrics.counts(*projections.edgeless(own.join(goals, ["k", "g"]).select("graph_id", bounds.moore_column(k, g).alias("n"))))


@query("SELECT r_name AS graph_id, 0::BIGINT AS num_nodes, 0::BIGINT AS num_edges, true AS is_k_regular, NULL::INT AS girth FROM region")
def empty_graph(spark, sf_dir):
    """The figures of a graph without vertices, one for each region."""
    names = projections.read(spark, sf_dir, "region").select(F.col("r_name").alias("graph_id"))
    goals = names.select("graph_id", F.lit(K).alias("k"), F.lit(G).alias("g"))
    found = validate.validate(*projections.edgeless(names.withColumn("n", F.lit(0))), goals)
    return found.select("graph_id", "num_nodes", "num_edges", "is_k_regular", "girth")


REQUEST = "graph STRING, minNodes INT, maxNodes INT, minProb DOUBLE, maxProb DOUBLE, allowSelfLoops BOOLEAN"


@query(f"""SELECT o_orderkey AS request, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 7)::INT ELSE {RANDOM_GRAPH['min_nodes']} END AS min_nodes, {RANDOM_GRAPH['max_nodes']} AS max_nodes,
    CASE WHEN o_orderkey % 3 = 0 THEN 0.25::DOUBLE ELSE {RANDOM_GRAPH['min_prob']}::DOUBLE END AS min_prob, {RANDOM_GRAPH['max_prob']}::DOUBLE AS max_prob, o_orderkey % 5 <> 0 AS loops, o_orderpriority AS graph FROM orders""")
def request_defaults(spark, sf_dir):
    o, key = projections.read(spark, sf_dir, "orders"), F.col("o_orderkey")
    body = F.to_json(F.struct(F.col("o_orderpriority").alias("graph"), F.when(key % 2 == 0, (key % 7).cast("int")).alias("minNodes"), F.when(key % 3 == 0, 0.25).alias("minProb"), F.when(key % 5 == 0, False).alias("allowSelfLoops")))
    asked = edge_lists.requests(o.select(key.alias("request"), body.alias("body")), REQUEST, ["graph"])
    return edge_lists.with_defaults(asked).select("request", "min_nodes", "max_nodes", "min_prob", "max_prob", "loops", "graph")


@query(f"""{FIGURES} SELECT graph_id, to_json({{'k': k, 'g': g, 'num_nodes': n, 'num_edges': m, 'girth': girth, 'is_k_regular': regular, 'is_valid_cage': regular AND coalesce(girth = g, false),
    'moore_bound': mb, 'is_optimal': regular AND coalesce(girth = g, false) AND n = mb}})::VARCHAR AS document FROM t_f""")
def validation_document(spark, sf_dir):
    return edge_lists.documents(validate.validate(*t(spark, sf_dir), wanted(spark, sf_dir)), "graph_id")


@query("SELECT user_id AS session_id, to_json({'steps': count(*), 'success': count(*) FILTER (event_type = 'purchase') > 0, 'last': max(event_id)})::VARCHAR AS document FROM events GROUP BY user_id")
def status_document(spark, sf_dir):
    events = projections.read(spark, sf_dir, "events")
    rows = events.groupBy(F.col("user_id").alias("session_id")).agg(F.count("*").alias("steps"), (F.count_if(F.col("event_type") == "purchase") > 0).alias("success"), F.max("event_id").alias("last"))
    return edge_lists.documents(rows, "session_id")


@query(f"WITH {graph('h')} SELECT graph_id AS \"graphId\", node_id AS \"nodeId\", degree AS \"trueDegree\", degree::DOUBLE AS \"predictedDegree\" FROM h_d")
def camel_predictions(spark, sf_dir):
    return basic.camel(layers.predict(*h(spark, sf_dir)))


# --- bounds and guards ------------------------------------------------------------------

@query(f"WITH {ASKED} SELECT k, g FROM a WHERE k >= 2 AND g >= 3")
def valid_targets(spark, sf_dir):
    return asked(spark, sf_dir).filter(bounds.valid_column(F.col("k"), F.col("g")))


@query(f"{FIGURES} SELECT f.graph_id, f.n AS num_nodes FROM t_f f WHERE f.n <= {bounds.upper(K, G)}")
def within_upper_bound(spark, sf_dir):
    vertices, edges = t(spark, sf_dir)
    return metrics.counts(vertices, edges).filter(F.col("num_nodes") <= bounds.upper(K, G)).select("graph_id", "num_nodes")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN round(l_tax / l_discount, 9) END AS ratio FROM lineitem")
def finite_ratio(spark, sf_dir):
    lines = projections.read(spark, sf_dir, "lineitem")
    ratio = F.when(F.col("l_discount") > 0, F.col("l_tax") / F.col("l_discount")).otherwise(float("inf"))
    return lines.select("l_orderkey", "l_linenumber", F.round(basic.finite(ratio), 9).alias("ratio"))


# --- edits ------------------------------------------------------------------------------


@query(f"WITH {graph('h')} SELECT graph_id, u, v FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY {drawn('5', 'graph_id', 'u', 'v')}, u, v) AS place FROM h_e) WHERE place <= 3")
def drawn_edges(spark, sf_dir):
    return edits.one_each(h(spark, sf_dir)[1], ["u", "v"], 5, 3)


LIGHT = f"""{graph("t")}, l AS (SELECT *, (degree > 1)::INT AS busy FROM t_d), m AS (SELECT graph_id, min(busy) AS busy FROM l GROUP BY graph_id),
    x AS (SELECT graph_id, node_id FROM (SELECT l.graph_id, l.node_id, row_number() OVER (PARTITION BY l.graph_id ORDER BY {drawn('2', 'l.graph_id', 'l.node_id')}, l.node_id) AS place FROM l JOIN m USING (graph_id, busy)) WHERE place = 1)"""


@query(f"WITH {LIGHT} SELECT v.graph_id, v.node_id FROM t_v v ANTI JOIN x USING (graph_id, node_id)")
def light_vertex_removed(spark, sf_dir):
    return edits.remove_random_vertex(*t(spark, sf_dir), seed=2)[0]


FULL = f"""{graph("t")}, f AS (SELECT graph_id, node_id FROM (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY {drawn('9', 'graph_id', 'node_id')}, node_id) AS place FROM t_d WHERE degree > {K}) WHERE place = 1),
    c AS (SELECT DISTINCT a.graph_id, a.src, a.dst FROM t_a a JOIN f ON f.graph_id = a.graph_id AND f.node_id = a.src),
    x AS (SELECT graph_id, least(src, dst) AS u, greatest(src, dst) AS v FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY {drawn('9', 'graph_id', 'src', 'dst')}, src, dst) AS place FROM c) WHERE place = 1)"""


@query(f"WITH {FULL} SELECT e.graph_id, e.u, e.v FROM t_e e ANTI JOIN x ON x.graph_id = e.graph_id AND x.u = e.u AND x.v = e.v")
def full_edge_removed(spark, sf_dir):
    return edits.remove_edge_above(*t(spark, sf_dir), K, seed=9)


ONE = f"x AS (SELECT graph_id, u, v FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY {drawn('4', 'graph_id', 'u', 'v')}, u, v) AS place FROM s) WHERE place = 1)"


@query(f"{SAFE}, {ONE} SELECT * FROM t_e UNION SELECT * FROM x")
def low_edge_added(spark, sf_dir):
    return candidates.add_low_edge(*t(spark, sf_dir), K, G, seed=4)


def feistel(seed: int) -> str:
    """The permutation of draws (see operators/sampling.py) in SQL: l and r after each round."""
    out = "f0 AS (SELECT graph_id, ranks, size, turn, turn // size AS l, turn % size AS r FROM d)"
    for i in range(4):
        mask = f"floor({drawn(repr(str(seed)), 'graph_id', repr(str(i)), 'r')} * size)::BIGINT"
        out += f", f{i + 1} AS (SELECT graph_id, ranks, size, turn, r AS l, xor(l, {mask}) AS r FROM f{i})"
    return out


SAMPLED = f"""i AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS i FROM low),
    z AS (SELECT graph_id, count(*) * (count(*) - 1) // 2 AS ranks FROM i GROUP BY graph_id HAVING count(*) > 1),
    d AS (SELECT graph_id, ranks, size, unnest(range(size * size)) AS turn FROM (SELECT *, (2 ** greatest(ceil(log2(ranks) / 2), 1))::BIGINT AS size FROM z)),
    {feistel(6)}, k AS (SELECT graph_id, turn, l * size + r AS rank FROM f4 WHERE l * size + r < ranks),
    j AS (SELECT graph_id, turn, rank, floor((1 + sqrt(1 + 8 * rank)) / 2)::BIGINT AS j FROM k),
    q AS (SELECT j.graph_id, turn, a.node_id AS u, b.node_id AS v FROM j JOIN i a ON a.graph_id = j.graph_id AND a.i = rank - j * (j - 1) // 2 JOIN i b ON b.graph_id = j.graph_id AND b.i = j),
    p50 AS (SELECT graph_id, u, v FROM (SELECT q.*, row_number() OVER (PARTITION BY q.graph_id ORDER BY turn) AS place FROM q JOIN s USING (graph_id, u, v)) JOIN t_c c USING (graph_id) WHERE place <= least(50, c.num_nodes * c.num_nodes))"""


@query(f"{SAFE}, {SAMPLED} SELECT * FROM p50")
def sampled_pairs(spark, sf_dir):
    return candidates.sampled_pairs(*t(spark, sf_dir), K, G, seed=6)


@query(f"""{SAFE}, {SAMPLED} SELECT DISTINCT graph_id, 'add_vertex' AS type, NULL::BIGINT AS u, NULL::BIGINT AS v FROM t_v UNION ALL SELECT graph_id, 'add_edge', u, v FROM p50
    UNION ALL SELECT graph_id, 'remove_edge', u, v FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY {drawn('6', 'graph_id', 'u', 'v')}, u, v) AS place FROM t_e) WHERE place <= 3
    UNION ALL SELECT graph_id, 'remove_vertex', node_id, NULL FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY {drawn('6', 'graph_id', 'node_id')}, node_id) AS place FROM t_v) WHERE place <= 2""")
def action_union(spark, sf_dir):
    return candidates.sampled_actions(*t(spark, sf_dir), K, G, seed=6)


@query(f"WITH {PLACED}, m AS (SELECT graph_id, coalesce(min(CASE WHEN node_id <> idx THEN idx END), count(*)) AS free FROM i GROUP BY graph_id) SELECT graph_id, node_id, round(x, 6) + 0.0::DOUBLE AS x, round(y, 6) + 0.0::DOUBLE AS y FROM pos UNION ALL SELECT graph_id, free, 12, -7 FROM m")
def vertex_placed(spark, sf_dir):
    return rounded_places(edits.place_vertex(layout.circle(t(spark, sf_dir)[0]), 12, -7))


@query(f"WITH {graph('h')} SELECT graph_id, node_id, degree AS true_degree, NULL::DOUBLE AS predicted_degree FROM h_d")
def cleared_predictions(spark, sf_dir):
    return edits.clear_predictions(layers.predict(*h(spark, sf_dir)), "predicted_degree")


@query("""SELECT parent, child FROM (SELECT o_custkey AS parent, o_orderkey AS child, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 5 > 0 THEN ((o_orderkey % 5) * (o_orderkey % 97) / 97::DOUBLE) / (o_orderkey % 5) ELSE 0 END DESC, o_orderkey) AS place FROM orders) WHERE place = 1""")
def mean_best(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = projections.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent"), key.alias("child"), (key % 5).alias("visits"), ((key % 5) * (key % 97) / 97).alias("value"))
    return candidates.best_mean(rows)


# --- model ------------------------------------------------------------------------------


@query(f"WITH {SIMPLE} SELECT graph_id, node_id, round(greatest(0.0::DOUBLE, (x0 - 1.5) / sqrt(4.0::DOUBLE + 1e-5) * 2 + 0.25), 9) AS y0, round(greatest(0.0::DOUBLE, (x1 - 0.5) / sqrt(0.25::DOUBLE + 1e-5) * -1 + 0.5), 9) AS y1 FROM z")
def normalised_positive(spark, sf_dir):
    found = layers.normalised(simple(spark, sf_dir)[0], [1.5, 0.5], [4.0, 0.25], [2.0, -1.0], [0.25, 0.5])
    return found.select("graph_id", "node_id", F.round(F.col("features")[0], 9).alias("y0"), F.round(F.col("features")[1], 9).alias("y1"))


@query(f"WITH {SIMPLE} SELECT graph_id, node_id, round(CASE WHEN {drawn("7", "graph_id", "node_id", "0")} < 0.3 THEN 0.0 ELSE x0 / 0.7::DOUBLE END, 9) AS y0, round(CASE WHEN {drawn("7", "graph_id", "node_id", "1")} < 0.3 THEN 0.0 ELSE x1 / 0.7::DOUBLE END, 9) AS y1 FROM z")
def dropped_out(spark, sf_dir):
    found = layers.dropout(simple(spark, sf_dir)[0], 0.3, 2, seed=7)
    return found.select("graph_id", "node_id", F.round(F.col("features")[0], 9).alias("y0"), F.round(F.col("features")[1], 9).alias("y1"))


@query(f"WITH {graph('h')}, p AS (SELECT graph_id, node_id, degree, greatest(0, round_even((degree + {drawn('graph_id', 'node_id')} * 2 - 1)::DOUBLE, 0))::DOUBLE AS guess FROM h_d) SELECT v.graph_id, v.node_id, p.guess AS predicted_degree, p.guess IS NOT NULL AS has_prediction, p.guess <> p.degree AS is_wrong FROM h_v v LEFT JOIN p ON p.graph_id = v.graph_id AND p.node_id = v.node_id AND v.node_id % 3 <> 0")
def prediction_attach(spark, sf_dir):
    found = guessed(spark, sf_dir).filter("node_id % 3 <> 0")
    return layers.attach(h(spark, sf_dir)[0], found).select("graph_id", "node_id", "predicted_degree", "has_prediction", "is_wrong")


@query(f"WITH {graph('h')} SELECT graph_id, node_id, round({drawn('11', 'graph_id', 'node_id', chr(39) + '0' + chr(39))}, 9) AS a, round({drawn('11', 'graph_id', 'node_id', chr(39) + '1' + chr(39))}, 9) AS b FROM h_v")
def seeded_vectors(spark, sf_dir):
    found = layers.seeded(h(spark, sf_dir)[0], 2, seed=11)
    return found.select("graph_id", "node_id", F.round(F.col("features")[0], 9).alias("a"), F.round(F.col("features")[1], 9).alias("b"))


# --- histories and sessions -------------------------------------------------------------


@query("SELECT event_id // 100 AS epoch, round(avg(value), 9) AS loss FROM events GROUP BY epoch")
def epoch_loss(spark, sf_dir):
    rows = projections.read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 100).alias("epoch"), F.col("value").alias("loss"))
    return history.epoch_loss(rows).select("epoch", F.round("loss", 9).alias("loss"))


@query("SELECT o_orderkey AS epoch, (o_orderkey % 50)::DOUBLE AS accuracy, (o_orderkey % 7)::DOUBLE AS mae FROM orders ORDER BY accuracy DESC, mae, epoch LIMIT 1")
def best_epoch(spark, sf_dir):
    key = F.col("o_orderkey")
    return history.best_epoch(projections.read(spark, sf_dir, "orders").select(key.alias("epoch"), (key % 50).cast("double").alias("accuracy"), (key % 7).cast("double").alias("mae")))


@query("""SELECT k, g, generator, success, final_n, steps, walker FROM (SELECT *, row_number() OVER (PARTITION BY k, g, generator ORDER BY NOT success, final_n, steps, walker) AS place
    FROM (SELECT (o_custkey % 3 + 3)::INT AS k, (o_custkey % 4 + 5)::INT AS g, o_orderpriority AS generator, o_orderstatus = 'F' AS success, o_orderkey % 60 AS final_n, o_orderkey % 1000 AS steps, o_orderkey AS walker FROM orders)) WHERE place = 1""")
def best_walker(spark, sf_dir):
    o, key, cust = projections.read(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    rows = o.select((cust % 3 + 3).cast("int").alias("k"), (cust % 4 + 5).cast("int").alias("g"), F.col("o_orderpriority").alias("generator"), (F.col("o_orderstatus") == "F").alias("success"), (key % 60).alias("final_n"), (key % 1000).alias("steps"), key.alias("walker"))
    return runner.best_of_walkers(rows)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS place FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE place = 1 OR event_type IS DISTINCT FROM b")
def changed_events(spark, sf_dir):
    events = projections.read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return history.changed(events, "user_id", "event_type", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id FROM (SELECT *, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts) AS wait FROM events) WHERE wait IS NULL OR wait >= 3600000000")
def debounced(spark, sf_dir):
    events = projections.read(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return session.debounced(events, "user_id", "ts", 3600, "event_id").select("user_id", "event_id")


#: Sessions of events, counted in ticks of ten minutes: signups start them, purchases stop them.
TICK, LIMITS = 600, lifetimes.Rules(idle=72, keep=144, sweep=36, most=300)


@query(f"""WITH RECURSIVE x AS (SELECT user_id AS session, epoch_us(ts) // {TICK * 1_000_000} AS tick, coalesce(event_type, '') AS kind FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    w AS (SELECT epoch_ms(max(ts)) // {TICK * 1000} AS until FROM events),
    c AS (SELECT session, tick, count(*) FILTER (kind = 'signup') > 0 AS begins, count(*) FILTER (kind NOT IN ('signup', 'purchase')) AS asks, count(*) FILTER (kind = 'purchase') > 0 AS halts FROM x, w WHERE tick < until GROUP BY ALL
        UNION ALL SELECT DISTINCT session, until, false, 0, false FROM x, w),
    r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY tick) AS rn FROM c),
    life AS (SELECT DISTINCT session, 0::BIGINT AS rn, 'none' AS stage, 0::BIGINT AS started, 0::BIGINT AS last, 0::BIGINT AS ended, 0::BIGINT AS polls, 0::BIGINT AS steps,
            [{{'event': 'none', 'started': 0::BIGINT, 'tick': 0::BIGINT, 'polls': 0::BIGINT, 'steps': 0::BIGINT}}] AS said FROM x
        UNION ALL SELECT session, rn, CASE WHEN halts THEN 'none' ELSE stage END, started, last, ended, polls, steps,
            CASE WHEN halts AND stage <> 'none' THEN list_append(said, {{'event': 'stopped', 'started': started, 'tick': tick, 'polls': polls, 'steps': CASE stage WHEN 'running' THEN tick - started ELSE steps END}}) ELSE said END
        FROM (SELECT session, place AS rn, tick, halts, CASE WHEN begins AND stage <> 'running' THEN 'running' ELSE stage END AS stage, CASE WHEN begins AND stage <> 'running' THEN tick ELSE started END AS started,
                CASE WHEN begins OR (asks > 0 AND stage <> 'none') THEN tick ELSE last END AS last, ended, steps,
                CASE WHEN begins AND stage <> 'running' THEN 0 ELSE polls END + CASE WHEN begins OR stage <> 'none' THEN asks ELSE 0 END AS polls,
                CASE WHEN begins AND stage IN ('complete', 'abandoned') THEN list_append(said, {{'event': 'evicted', 'started': started, 'tick': tick, 'polls': polls, 'steps': steps}}) ELSE said END AS said
            FROM (SELECT * REPLACE (CASE WHEN stage = 'abandoned' AND sweep <= tick THEN 'none' ELSE stage END AS stage,
                    CASE WHEN stage = 'abandoned' AND sweep <= tick THEN list_append(said, {{'event': 'evicted', 'started': started, 'tick': sweep, 'polls': polls, 'steps': steps}}) ELSE said END AS said)
                FROM (SELECT *, CAST(ceil(greatest(last + {LIMITS.keep + 1}, ended) / {LIMITS.sweep}) AS BIGINT) * {LIMITS.sweep} AS sweep
                    FROM (SELECT * REPLACE (CASE WHEN over THEN outcome ELSE stage END AS stage, CASE WHEN over THEN deadline ELSE ended END AS ended, CASE WHEN over THEN deadline - started ELSE steps END AS steps,
                            CASE WHEN over THEN list_append(said, {{'event': outcome, 'started': started, 'tick': deadline, 'polls': polls, 'steps': deadline - started}}) ELSE said END AS said)
                        FROM (SELECT *, stage = 'running' AND deadline <= tick AS over
                            FROM (SELECT life.*, r.rn AS place, tick, begins, asks, halts, least(last + {LIMITS.idle + 1}, started + {LIMITS.most}) AS deadline, CASE WHEN last + {LIMITS.idle + 1} <= started + {LIMITS.most} THEN 'abandoned' ELSE 'complete' END AS outcome
                                FROM life JOIN r ON r.session = life.session AND r.rn = life.rn + 1) a) b) c) d) e) f)
    SELECT session, s.event AS event, make_timestamp(s.started * {TICK * 1_000_000}) AS started, make_timestamp(s.tick * {TICK * 1_000_000}) AS happened, s.polls AS polls, s.steps AS steps
    FROM (SELECT session, unnest(said[2:]) AS s FROM (SELECT session, said, rn, max(rn) OVER (PARTITION BY session) AS newest FROM life) WHERE rn = newest)""")
def session_lifetimes(spark, sf_dir):
    """What timers and requests make of the sessions of a stream of events, up to its watermark."""
    stored = projections.read(spark, sf_dir, "events").schema
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "stop").otherwise("poll")
    stream = spark.readStream.schema(stored).parquet(f"{sf_dir}/events.parque[t]").select(F.col("user_id").alias("session"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at"))
    return lifetimes.drained(lifetimes.replayed(stream, LIMITS, TICK), f"{shared_dir(spark)}/ringspark/lifetimes-{uuid.uuid4().hex}").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "happened")})


@query("SELECT count(*) AS active FROM (SELECT user_id FROM events GROUP BY user_id HAVING (SELECT epoch(max(ts)) FROM events) - epoch(max(ts)) <= 86400)")
def active_sessions(spark, sf_dir):
    events = projections.read(spark, sf_dir, "events").select("user_id", "ts")
    return session.active(events, "user_id", "ts", events.agg(F.max("ts")).scalar(), 86_400)


@query("SELECT user_id FROM (SELECT user_id, max(ts) AS last, max(event_id) % 2 = 0 AS stopped FROM events GROUP BY user_id) WHERE stopped AND (SELECT epoch(max(ts)) FROM events) - epoch(last) > 86400")
def evicted_sessions(spark, sf_dir):
    events = projections.read(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).scalar()
    rows = events.groupBy("user_id").agg(F.max("ts").alias("last"), (F.max("event_id") % 2 == 0).alias("stopped"))
    return session.evicted(rows, now, 86_400).select("user_id")


@query("SELECT event_id, substr(md5(event_id::VARCHAR), 1, 8) AS short_id, lower(event_type) = 'click' AS clicked, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp, round(epoch(ts) - (SELECT epoch(min(ts)) FROM events), 3) AS elapsed FROM events")
def stamps(spark, sf_dir):
    events = projections.read(spark, sf_dir, "events")
    first = events.agg(F.min("ts")).scalar()
    return events.select("event_id", basic.short(F.md5(F.col("event_id").cast("string"))).alias("short_id"), basic.same_text(F.col("event_type"), "Click").alias("clicked"), basic.iso(F.col("ts")).alias("stamp"), F.round(basic.elapsed(first, F.col("ts")), 3).alias("elapsed"))


@query("SELECT count(*) AS rows, count(*) AS different, true AS formed FROM events")
def fresh_ids(spark, sf_dir):
    rows = projections.read(spark, sf_dir, "events").select(basic.new_id().alias("id"))
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("different"), F.bool_and(F.col("id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("formed"))


@query("SELECT event_id, CASE WHEN s < 1 THEN round(s * 1000)::BIGINT || 'ms' WHEN s < 60 THEN printf('%.1f', s) || 's' ELSE (floor(s)::BIGINT // 60) || 'm ' || (floor(s)::BIGINT % 60) || 's' END AS text FROM (SELECT event_id, (event_id % 4000) / 16.0::DOUBLE + 0.03125::DOUBLE AS s FROM events)")
def durations(spark, sf_dir):
    rows = projections.read(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 4000) / 16 + 0.03125).alias("s"))
    return rows.select("event_id", basic.duration(F.col("s")).alias("text"))


@query("SELECT user_id, coalesce(max(CASE WHEN event_type = 'click' THEN event_id END), -1) AS last_click FROM events GROUP BY user_id")
def map_default(spark, sf_dir):
    last = projections.read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last"))
    maps = last.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "last"))).alias("m"))
    return maps.select("user_id", basic.default(F.col("m"), "click", -1).alias("last_click"))


@query("SELECT event_id, round(100 * (least(greatest(value, 10), 60) - 10) / 50, 9) AS percent FROM events")
def percentages(spark, sf_dir):
    rows = projections.read(spark, sf_dir, "events")
    return rows.select("event_id", F.round(basic.percentage(F.col("value"), 10.0, 60.0), 9).alias("percent"))


# --- searches ---------------------------------------------------------------------------


@query(f"SELECT (s_suppkey % 3 + 3)::INT AS k, (s_nationkey % 5 + 5)::INT AS g, s_name AS name, generator, walker::INT AS walker FROM supplier, (VALUES {', '.join(f"('{x}')" for x in GENERATORS)}) y(generator), range(3) w(walker)")
def search_jobs(spark, sf_dir):
    asked_for = projections.read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 3 + 3).cast("int").alias("k"), (F.col("s_nationkey") % 5 + 5).cast("int").alias("g"), F.col("s_name").alias("name"))
    return runner.jobs(asked_for, GENERATORS, 3)


@query(f"SELECT k::INT AS k, g::INT AS g, true AS consistent FROM (VALUES {', '.join(f'({k}, {g})' for _, k, g, _, _ in TARGETS)}) t(k, g)")
def search_walk_checked(spark, sf_dir):
    """Whether each walk's claim is true of its graph, by the degrees and girths of the tables."""
    found = held(runner.run(runner.targets(spark), ["randomwalk"]).select("k", "g", "success", "final_n", "edges"))
    name = F.concat_ws("-", "k", "g")
    edges = found.select(name.alias("graph_id"), F.explode("edges").alias("e")).select("graph_id", "e.u", "e.v")
    vertices = edges.select("graph_id", F.col("u").alias("node_id")).union(edges.select("graph_id", "v")).distinct()
    goals = found.select(name.alias("graph_id"), "k", "g")
    claims = validate.validate(vertices, edges, goals).select("graph_id", "is_valid_cage", "num_nodes")
    own = found.withColumn("graph_id", name).join(claims, "graph_id", "left")
    return own.select("k", "g", (F.col("success") == (F.coalesce("is_valid_cage", F.lit(False)) & (F.col("num_nodes") == F.col("final_n")))).alias("consistent"))


@query(f"WITH {graph('t')}, f AS (SELECT graph_id, md5(string_agg(u || '-' || v, ',' ORDER BY u, v)) AS fingerprint FROM t_e GROUP BY graph_id) SELECT DISTINCT fingerprint FROM f")
def visited_insert(spark, sf_dir):
    states = fingerprint.edge_hash(t(spark, sf_dir)[1])
    visited = states.filter(F.col("graph_id").like("____-__-0%")).select("fingerprint")
    return fingerprint.insert(visited, states)


#: The degree and girth that sessions search for depth first, from the suppliers' random graphs.
FULL, SHORT = 4, 3
EDIT = f"(share + {sql.NEAR.format(a='n', b='mb')} + {sql.term('girth')}) / 3"


@query(f"""WITH RECURSIVE {sql.figures("r", f"SELECT graph_id, {FULL}::INT AS k, {SHORT}::INT AS g, {bounds.moore(FULL, SHORT)}::BIGINT AS mb FROM (SELECT DISTINCT graph_id FROM r_v)")}, {sql.distance("r")},
    o AS (SELECT *, share * n AS own FROM r_f WHERE n <= {bounds.upper(FULL, SHORT)} AND NOT (regular AND coalesce(girth = g, false))),
    low AS (SELECT d.* FROM r_d d WHERE d.degree < {FULL}),
    p AS (SELECT a.graph_id, a.node_id AS u, b.node_id AS v, (a.degree + 1 = {FULL})::INT + (b.degree + 1 = {FULL})::INT AS more FROM low a JOIN low b ON a.graph_id = b.graph_id AND a.node_id < b.node_id),
    e AS (SELECT o.graph_id, p.u, p.v, n, m + 1 AS m, more, (own + more) / n AS share, least(girth, w.distance + 1)::BIGINT AS girth, g, mb FROM p JOIN o USING (graph_id) LEFT JOIN r_w w ON w.graph_id = p.graph_id AND w.src = p.u AND w.dst = p.v
        WHERE coalesce(w.distance, 999999) > {SHORT - 2}),
    s AS (SELECT graph_id, 'edge' AS kind, u, v, n, m, round({EDIT} + 0.2 * more, 9) AS score FROM e
        UNION ALL SELECT graph_id, 'vertex', (SELECT max(node_id) + 1 FROM r_v x WHERE x.graph_id = o.graph_id), NULL, n + 1, m, round(CASE WHEN n < mb THEN 1.0 WHEN n = mb THEN 0.5 ELSE greatest(0.0, 0.3 - 0.1 * (n - mb)) END, 9) FROM o WHERE n < 2 * mb)
    SELECT graph_id AS session, kind, u, v, n, m, score::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY score DESC, kind, u DESC, v DESC) AS place FROM s) WHERE place = 1""")
def depth_first_step(spark, sf_dir):
    """The state that each supplier's session goes to first, depth first."""
    stack = frontier.run(*r(spark, sf_dir), FULL, SHORT, rounds=1, deep=True).frontier
    top = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("score"), "kind", F.desc("u"), F.desc("v")))
    return stack.withColumn("top", top).filter("top = 1").select("session", "kind", "u", "v", "n", "m", "score")


@query()
def depth_first_search(spark, sf_dir):
    """Four steps down from each supplier's graph."""
    return frontier.run(*r(spark, sf_dir), FULL, SHORT, rounds=4, deep=True).sessions.select("session", "success", "explored")


#: The girth of graphs of degree K that sessions search for from the hours' graphs.
SOUGHT = 7


def best_first(n: str, m: str, share: str, cycle: str) -> str:
    size, full = sql.NEAR.format(a=n, b="mb"), sql.NEAR.format(a=m, b=f"({n} * k // 2)")
    return f"round(0.3 * (({share} + {size} + {sql.term(cycle)}) / 3) + 0.3 * {share} + 0.15 * {size} + 0.15 * {full} + 0.1 * {sql.term(cycle)}, 9)"


@query(f"""WITH RECURSIVE {sql.figures("t", f"SELECT graph_id, {K}::INT AS k, {SOUGHT}::INT AS g, {bounds.moore(K, SOUGHT)}::BIGINT AS mb FROM (SELECT DISTINCT graph_id FROM t_v)")}, {sql.distance("t")},
    o AS (SELECT *, share * n AS own FROM t_f WHERE n <= {bounds.upper(K, SOUGHT)} AND NOT (regular AND coalesce(girth = g, false))),
    low AS (SELECT d.* FROM t_d d WHERE d.degree < {K}),
    p AS (SELECT a.graph_id, a.node_id AS u, b.node_id AS v, (a.degree + 1 = {K})::INT + (b.degree + 1 = {K})::INT AS more FROM low a JOIN low b ON a.graph_id = b.graph_id AND a.node_id < b.node_id),
    s AS (SELECT o.graph_id, 'edge' AS kind, p.u, p.v, n, m + 1 AS m, (own + more) / n AS share, least(girth, w.distance + 1)::BIGINT AS girth, k, g, mb FROM p JOIN o USING (graph_id) LEFT JOIN t_w w ON w.graph_id = p.graph_id AND w.src = p.u AND w.dst = p.v
        WHERE coalesce(w.distance, 999999) > {SOUGHT - 2} UNION ALL
        SELECT graph_id, 'vertex', (SELECT max(node_id) + 1 FROM t_v x WHERE x.graph_id = o.graph_id), NULL, n + 1, m, own / (n + 1), girth, k, g, mb FROM o WHERE n < 2 * mb)
    SELECT graph_id AS session, kind, u, v, n, m, girth, {best_first("n", "m", "share", "girth")} AS score FROM s""")
def frontier_round(spark, sf_dir):
    """The frontier of each hour's session after its first state is expanded."""
    found = frontier.run(*t(spark, sf_dir), K, SOUGHT, rounds=1)
    return found.frontier.select("session", "kind", "u", "v", "n", "m", "girth", "score")


@query()
def frontier_search(spark, sf_dir):
    """Four rounds of best-first search from each hour's graph; tests compare rounds with a plain search."""
    return frontier.run(*t(spark, sf_dir), K, SOUGHT, rounds=4).sessions


# --- layout -----------------------------------------------------------------------------


@query(f"""WITH {PLACED}, f AS (SELECT graph_id, src AS node_id, sum(((CASE WHEN joined THEN 0.05 * (d - 100) ELSE 0 END) - 3000 / (d * d)) * dx / d) AS fx, sum(((CASE WHEN joined THEN 0.05 * (d - 100) ELSE 0 END) - 3000 / (d * d)) * dy / d) AS fy FROM nb WHERE d >= 0.1 GROUP BY ALL),
    s AS (SELECT graph_id, node_id, x, y, 0.85 * (node_id - 1 + coalesce(fx, 0) - 0.001 * x) AS vx, 0.85 * (2 - node_id + coalesce(fy, 0) - 0.001 * y) AS vy FROM pos LEFT JOIN f USING (graph_id, node_id))
    SELECT graph_id, node_id, round(x + CASE WHEN node_id = 0 THEN 0 ELSE vx END, 6) + 0.0::DOUBLE AS x, round(y + CASE WHEN node_id = 0 THEN 0 ELSE vy END, 6) + 0.0::DOUBLE AS y, round(CASE WHEN node_id = 0 THEN -1 ELSE vx END, 6) + 0.0::DOUBLE AS vx, round(CASE WHEN node_id = 0 THEN 2 ELSE vy END, 6) + 0.0::DOUBLE AS vy FROM s""")
def layout_step_velocity(spark, sf_dir):
    vertices, edges = t(spark, sf_dir)
    moving = layout.circle(vertices).withColumns({"vx": (F.col("node_id") - 1).cast("double"), "vy": (2 - F.col("node_id")).cast("double"), "fixed": F.col("node_id") == 0})
    found = layout.legacy_step(moving, edges)
    return found.select("graph_id", "node_id", *((F.round(c, 6) + 0.0).alias(c) for c in ("x", "y", "vx", "vy")))


@query(f"WITH {PLACED} SELECT graph_id, node_id, round(x, 6) + 0.0::DOUBLE AS x, round(y, 6) + 0.0::DOUBLE AS y, 0.0::DOUBLE AS vx FROM pos")
def layout_switched_off(spark, sf_dir):
    vertices, edges = t(spark, sf_dir)
    found = layout.legacy_step(layout.circle(vertices), edges, on=False)
    return found.select("graph_id", "node_id", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"), "vx")


@query(f"WITH {PLACED} SELECT graph_id, node_id, round(x + ({drawn('1', 'graph_id', 'node_id', chr(39) + 'x' + chr(39))} - 0.5) * 10, 6) + 0.0::DOUBLE AS x, round(y + ({drawn('1', 'graph_id', 'node_id', chr(39) + 'y' + chr(39))} - 0.5) * 10, 6) + 0.0::DOUBLE AS y FROM pos")
def layout_jitter(spark, sf_dir):
    return rounded_places(layout.jitter(layout.circle(t(spark, sf_dir)[0]), seed=1))


def spread(spark, sf_dir):
    """The places of one large graph: a circle whose vertices are moved by up to its radius."""
    return layout.jitter(layout.circle(projections.supply(spark, sf_dir)[0]), seed=2, width=400.0)


@query(f"""WITH {graph("b")}, i AS (SELECT graph_id, node_id, row_number() OVER (ORDER BY node_id) - 1 AS idx, count(*) OVER () AS n FROM b_v),
    p AS (SELECT graph_id, node_id, 200 * cos(idx / n::DOUBLE * (2 * pi()) - pi() / 2) + ({drawn('2', 'graph_id', 'node_id', chr(39) + 'x' + chr(39))} - 0.5) * 400 AS x, 200 * sin(idx / n::DOUBLE * (2 * pi()) - pi() / 2) + ({drawn('2', 'graph_id', 'node_id', chr(39) + 'y' + chr(39))} - 0.5) * 400 AS y FROM i)
    SELECT a.graph_id, a.node_id, count(b.node_id) AS acting FROM p a LEFT JOIN p b ON a.node_id <> b.node_id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) >= {repulsion.LEAST} GROUP BY ALL""")
def repulsion_acting(spark, sf_dir):
    """How many vertices push each vertex: every pair of cells counted once, and none twice."""
    return repulsion.forces(spread(spark, sf_dir), layout.LEGACY["repulsion"]).select("graph_id", "node_id", "acting")


@query()
def layout_step_cells(spark, sf_dir):
    """A step of the legacy model over one large graph, without its pairs; tests compare it with all of them."""
    found = layout.legacy_step(spread(spark, sf_dir), projections.supply(spark, sf_dir)[1], tolerance=0.05)
    return found.select("graph_id", "node_id", "x", "y", "vx", "vy")


# --- graphs larger than a task ----------------------------------------------------------


def numbers(text: str) -> str:
    return ", ".join(f"CAST(('0x' || substr(md5({text}), {at}, 15)) AS BIGINT)::HUGEINT AS {x}" for x, at in (("a", 1), ("b", 16)))


@query(f"""WITH {graph("b")}, l AS (SELECT 0 AS s, node_id AS u, node_id AS v, node_id::VARCHAR AS line FROM b_d WHERE degree = 0 UNION ALL SELECT 1, u, v, u || ' ' || v FROM b_e)
    SELECT 'supply' AS graph_id, (sum(strlen(line) + 1) OVER (ORDER BY s, u, v) - strlen(line) - 1)::BIGINT AS start, line FROM l""")
def printed_supply(spark, sf_dir):
    """Every line of the edge list of one large graph, with the byte where it starts in the text."""
    return sinks.placed(*projections.supply(spark, sf_dir))


@query(f"""WITH {graph("b")}, x AS (SELECT {numbers("u || '-' || v")} FROM b_e) SELECT 'supply' AS graph_id, (sum(a) % {multisets.WRAP})::BIGINT AS a, (sum(b) % {multisets.WRAP})::BIGINT AS b FROM x""")
def supply_fingerprint(spark, sf_dir):
    return multisets.of_edges(*projections.supply(spark, sf_dir))


#: States of an hour's graph: for every other edge of the hour before, the graph with that edge toggled.
STATES = f"""{graph("t")}, o AS (SELECT strftime(strptime(graph_id, '%Y-%m-%d %H') + INTERVAL 1 HOUR, '%Y-%m-%d %H') AS graph_id, u, v FROM t_e),
    d AS (SELECT graph_id, u || '/' || v AS state, u, v FROM o SEMI JOIN t_c USING (graph_id)),
    e AS (SELECT DISTINCT d.graph_id, state, t_e.u, t_e.v FROM d JOIN t_e USING (graph_id)),
    w AS (SELECT graph_id, state, u, v FROM (SELECT * FROM e UNION ALL SELECT graph_id, state, u, v FROM d) GROUP BY ALL HAVING count(*) = 1
        UNION ALL SELECT d.graph_id, d.state, NULL, NULL FROM d),
    n AS (SELECT graph_id, state, {numbers("coalesce(u || '-' || v, '')")}, u IS NULL AS none FROM w),
    f AS (SELECT graph_id, state, coalesce(sum(a) FILTER (NOT none), 0) % {multisets.WRAP} || '-' || coalesce(sum(b) FILTER (NOT none), 0) % {multisets.WRAP} AS fingerprint FROM n GROUP BY ALL),
    y AS (SELECT {numbers("u || '-' || v")}, graph_id FROM t_e), z AS (SELECT graph_id, sum(a) % {multisets.WRAP} || '-' || sum(b) % {multisets.WRAP} AS fingerprint FROM y GROUP BY graph_id)"""


def states(spark, sf_dir):
    """(fingerprints of the hours, fingerprints of their states)."""
    vertices, edges = t(spark, sf_dir)
    later = F.date_format(F.to_timestamp("graph_id", "yyyy-MM-dd HH") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd HH")
    tried = edges.select(later.alias("graph_id"), F.concat_ws("/", "u", "v").alias("state"), "u", "v")
    prints = multisets.of_edges(vertices, edges)
    return prints, multisets.edited(prints, edges, tried)


@query(f"WITH {STATES} SELECT graph_id, state, fingerprint FROM f")
def edited_fingerprints(spark, sf_dir):
    return multisets.named(states(spark, sf_dir)[1])


@query(f"WITH {STATES} SELECT fingerprint, min(graph_id || ' ' || state) AS graph_id FROM f WHERE fingerprint NOT IN (SELECT fingerprint FROM z) GROUP BY fingerprint")
def unseen_states(spark, sf_dir):
    """States that are no hour's graph, each fingerprint once."""
    seen, tried = states(spark, sf_dir)
    return fingerprint.unseen(multisets.named(tried).select(F.concat_ws(" ", "graph_id", "state").alias("graph_id"), "fingerprint"), multisets.named(seen))


def refined_sums(x: str, rounds: int) -> str:
    out = f"{graph(x)}, l0 AS (SELECT graph_id, node_id, degree::VARCHAR AS label FROM {x}_d)"
    for i in range(rounds):
        out += f""", n{i} AS (SELECT graph_id, node_id, label, {numbers("label")} FROM l{i}),
            l{i + 1} AS (SELECT l.graph_id, l.node_id, md5(any_value(l.label) || ':' || coalesce(sum(m.a), 0) % {multisets.WRAP} || ':' || coalesce(sum(m.b), 0) % {multisets.WRAP}) AS label
            FROM n{i} l LEFT JOIN {x}_a a ON a.graph_id = l.graph_id AND a.src = l.node_id LEFT JOIN n{i} m ON m.graph_id = a.graph_id AND m.node_id = a.dst GROUP BY l.graph_id, l.node_id)"""
    return out + f", g AS (SELECT graph_id, {numbers('label')} FROM l{rounds})"


@query(f"WITH {refined_sums('h', 3)} SELECT graph_id, (sum(a) % {multisets.WRAP})::BIGINT AS a, (sum(b) % {multisets.WRAP})::BIGINT AS b FROM g GROUP BY graph_id")
def refined_fingerprint(spark, sf_dir):
    return multisets.refined(*h(spark, sf_dir))


@query(f"""WITH RECURSIVE {graph("h")}, {sql.distance("h")}, p AS (SELECT graph_id, min(node_id) AS u, max(node_id) AS v FROM h_v GROUP BY graph_id UNION SELECT graph_id, min(node_id), min(node_id) + 7 FROM h_v GROUP BY graph_id)
    SELECT p.graph_id, p.u, p.v, coalesce(w.distance, 0)::BIGINT AS distance FROM p LEFT JOIN h_w w ON w.graph_id = p.graph_id AND w.src = p.u AND w.dst = p.v WHERE w.distance IS NOT NULL OR p.u = p.v""")
def asked_distances(spark, sf_dir):
    """Distances of two pairs of each day; the searches of other vertices are never begun."""
    vertices, edges = h(spark, sf_dir)
    least, most = F.min("node_id"), F.max("node_id")
    ends = vertices.groupBy("graph_id").agg(least.alias("u"), F.array(most, least + 7).alias("to"))
    return distances.asked(edges, ends.select("graph_id", "u", F.explode("to").alias("v")))
