"""Queries by name over the driver's tables, each beside its SQL.

Vertices and edges come from the projections: h hand-offs by day, b supply, n trade, f forest,
t hand-offs by hour, r random graphs drawn for the suppliers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringspark.functions import basic, bounds, score
from ringspark.operators import candidates, contraction, cycles, edits, fingerprint, history, layout, metrics, search, trees, validate
from ringspark.operators.lineage import held
from ringspark.operators.model import layers
from ringspark.operators.search.runner import run, targets
from ringspark.sources import edge_lists, projections
from ringspark.streaming import session

from . import sql
from .sql import graph, near, quality, term

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

K, G = 3, 5
#: The girth asked of an hour's graph, by the hour modulo 3.
GOALS = (5, 7, 9)
DEGREE = 6


def query(oracle: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return put


def h(spark, sf_dir):
    return projections.hand_off(spark, sf_dir)


def t(spark, sf_dir):
    return projections.hours(spark, sf_dir)


def r(spark, sf_dir):
    return projections.random_graphs(projections.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))


def wanted(spark, sf_dir):
    """(graph_id, k, g) of the hours."""
    turn = F.substring("graph_id", -2, 2).cast("int") % 3 + 1
    return t(spark, sf_dir)[0].select("graph_id").distinct().select("graph_id", F.lit(K).alias("k"), F.element_at(F.array(*map(F.lit, GOALS)), turn).alias("g"))


TURN = "(substr(graph_id, 12, 2)::INT % 3 + 1)"
WANTED = f"SELECT graph_id, {K}::INT AS k, list_extract({list(GOALS)}, {TURN})::INT AS g, list_extract({[bounds.moore(K, g) for g in GOALS]}, {TURN})::BIGINT AS mb FROM (SELECT DISTINCT graph_id FROM t_v)"
FIGURES = f"WITH RECURSIVE {sql.figures('t', WANTED)}"


def figures(spark, sf_dir):
    return validate.figures(*t(spark, sf_dir), wanted(spark, sf_dir))


# --- degrees and counts -----------------------------------------------------------------


@query(f"WITH {graph('h')} SELECT graph_id, node_id, degree FROM h_d")
def degree_all(spark, sf_dir):
    return metrics.degrees(*h(spark, sf_dir))


@query(f"WITH {graph('b')} SELECT node_id, degree FROM b_d")
def degree_supply(spark, sf_dir):
    return metrics.degrees(*projections.supply(spark, sf_dir)).select("node_id", "degree")


@query(f"WITH {graph('h')} SELECT v.graph_id, v.node_id, count(DISTINCT a.dst) AS neighbors FROM h_v v LEFT JOIN h_a a ON a.graph_id = v.graph_id AND a.src = v.node_id GROUP BY ALL")
def neighbor_count(spark, sf_dir):
    return metrics.neighbor_counts(*h(spark, sf_dir))


@query(f"WITH {graph('t')} SELECT graph_id, src AS node_id, string_agg(DISTINCT dst::VARCHAR, ',' ORDER BY dst::VARCHAR) AS neighbors FROM t_a GROUP BY ALL")
def neighbor_lists(spark, sf_dir):
    lists = metrics.neighbor_lists(t(spark, sf_dir)[1])
    return lists.withColumn("neighbors", F.array_join(F.sort_array(F.col("neighbors").cast("array<string>")), ","))


@query(f"WITH {graph('h')} SELECT * FROM h_c")
def graph_counts(spark, sf_dir):
    return metrics.counts(*h(spark, sf_dir))


@query(f"WITH {graph('b')} SELECT DISTINCT graph_id, u, v FROM b_e")
def edge_dedup(spark, sf_dir):
    return projections.supply(spark, sf_dir)[1]


@query(f"WITH {graph('n')} SELECT graph_id, u, v FROM n_e")
def edge_canonical(spark, sf_dir):
    return edits.canonical_edges(projections.trade(spark, sf_dir)[1])


@query(f"WITH {graph('f')} SELECT node_id, degree FROM f_d")
def degree_forest(spark, sf_dir):
    return metrics.degrees(*projections.forest(spark, sf_dir)).select("node_id", "degree")


@query(f"WITH {graph('h')} SELECT graph_id, u, v FROM h_e WHERE u = v")
def self_loops(spark, sf_dir):
    return metrics.self_loops(h(spark, sf_dir)[1])


@query(f"WITH {graph('t')} SELECT graph_id, node_id FROM t_d WHERE degree = 0")
def isolated_vertices(spark, sf_dir):
    return metrics.isolated(*t(spark, sf_dir))


@query(f"WITH {graph('h')} SELECT graph_id, min(degree) AS min_degree, max(degree) AS max_degree, min(degree) = max(degree) AS is_regular FROM h_d GROUP BY graph_id")
def regularity(spark, sf_dir):
    return metrics.regularity(*h(spark, sf_dir))


@query(f"WITH {graph('t')} SELECT graph_id, min(degree) AS min_degree, max(degree) AS max_degree, min(degree) = 3 AND max(degree) = 3 AS is_regular FROM t_d GROUP BY graph_id")
def regularity_k(spark, sf_dir):
    return metrics.regularity(*t(spark, sf_dir), k=K)


@query(f"WITH {graph('h')} SELECT graph_id, round(avg((degree = {DEGREE})::INT::DOUBLE), 9) AS share FROM h_d GROUP BY graph_id")
def regular_share(spark, sf_dir):
    return metrics.regular_share(*h(spark, sf_dir), DEGREE).withColumn("share", F.round("share", 9))


@query(f"WITH {graph('h')} SELECT graph_id, node_id, CASE WHEN degree < {DEGREE} THEN 'below' WHEN degree = {DEGREE} THEN 'at' ELSE 'above' END AS side FROM h_d")
def degree_partition(spark, sf_dir):
    return metrics.degree_partition(*h(spark, sf_dir), DEGREE)


@query(f"WITH {graph('h')} SELECT graph_id, num_nodes * {DEGREE} // 2 - num_edges AS deficit FROM h_c")
def edge_deficit(spark, sf_dir):
    return metrics.edge_deficit(*h(spark, sf_dir), DEGREE)


@query(f"""WITH {graph("h")}, s AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS i FROM h_v WHERE node_id >= 0)
    SELECT v.graph_id, max(v.node_id) + 1 AS after_max, count(*) AS num_nodes, any_value(f.free) AS smallest_free
    FROM h_v v JOIN (SELECT graph_id, coalesce(min(CASE WHEN node_id <> i THEN i END), count(*)) AS free FROM s GROUP BY graph_id) f USING (graph_id) GROUP BY v.graph_id""")
def next_id(spark, sf_dir):
    return metrics.next_ids(h(spark, sf_dir)[0])


@query(f"WITH {graph('h')} SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS idx FROM h_v")
def dense_index(spark, sf_dir):
    return metrics.dense_index(h(spark, sf_dir)[0]).select("graph_id", "node_id", "idx")


@query(f"WITH {graph('h')} SELECT graph_id, node_id, round((row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1) / greatest(count(*) OVER (PARTITION BY graph_id) - 1, 1)::DOUBLE, 9) AS norm FROM h_v")
def norm_index(spark, sf_dir):
    return metrics.dense_index(h(spark, sf_dir)[0]).select("graph_id", "node_id", F.round("norm", 9).alias("norm"))


# --- edge lists and documents -----------------------------------------------------------

TEXTS = f"""{graph("h")}, t AS (SELECT graph_id, string_agg(line, chr(10) ORDER BY s, u, v) AS text FROM (
        SELECT graph_id, 0 AS s, node_id AS u, node_id AS v, node_id::VARCHAR AS line FROM h_d WHERE degree = 0
        UNION ALL SELECT graph_id, {{edges}}, u, v, u || ' ' || v FROM h_e) GROUP BY graph_id)"""


@query(f"WITH {TEXTS.format(edges=1).replace('SELECT graph_id, 0 AS s', 'SELECT graph_id, 2 AS s')} SELECT * FROM t")
def print_edge_list(spark, sf_dir):
    return edge_lists.print_lines(*h(spark, sf_dir), isolated_first=False)


@query(f"WITH {TEXTS.format(edges=1)} SELECT * FROM t")
def canonical_round_trip(spark, sf_dir):
    return edge_lists.canonical(edge_lists.print_lines(*h(spark, sf_dir), isolated_first=False))


@query(f"WITH {graph('h')} SELECT graph_id, u, v FROM h_e")
def parse_strict(spark, sf_dir):
    return edge_lists.parse(edge_lists.print_lines(*h(spark, sf_dir)))[1]


#: Lines of odd forms made from the events of a day.
LINES = """CASE event_id % 8 WHEN 0 THEN '' WHEN 1 THEN ' ' || user_id || '  ' WHEN 2 THEN user_id || ' ' || event_id || ' more' WHEN 3 THEN event_type || ' 1'
    WHEN 4 THEN '+' || user_id || ' -' || event_id % 9 WHEN 5 THEN user_id || ' x' || event_id ELSE user_id || ' ' || event_id % 40 END"""
LINE_TEXTS = f"x AS (SELECT strftime(ts, '%Y-%m-%d') AS graph_id, string_agg({LINES}, chr(10) ORDER BY event_id) AS text FROM events GROUP BY 1)"


def texts(spark, sf_dir):
    line = F.expr(LINES)
    rows = projections.read(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("graph_id"), F.struct("event_id", line.alias("line")).alias("x"))
    return rows.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))


@query(f"""WITH {LINE_TEXTS}, l AS (SELECT graph_id, regexp_split_to_array(trim(line, ' '), '\\s+') AS p FROM (SELECT graph_id, unnest(string_split(text, chr(10))) AS line FROM x) WHERE trim(line, ' ') <> ''),
    n AS (SELECT graph_id, len(p) AS s, TRY_CAST(regexp_extract(p[1], '^([+-]?[0-9]+)', 1) AS BIGINT) AS a, TRY_CAST(regexp_extract(p[2], '^([+-]?[0-9]+)', 1) AS BIGINT) AS b FROM l),
    k AS (SELECT * FROM n WHERE a IS NOT NULL AND (s < 2 OR b IS NOT NULL))
    SELECT DISTINCT graph_id, least(a, b) AS u, greatest(a, b) AS v FROM k WHERE b IS NOT NULL""")
def parse_permissive(spark, sf_dir):
    return edge_lists.parse(texts(spark, sf_dir), "permissive")[1]


@query(f"""WITH {LINE_TEXTS}, y AS (SELECT graph_id, string_split(trim(text, ' ' || chr(10)), chr(10)) AS lines FROM x),
    l AS (SELECT graph_id, unnest(range(1, len(lines) + 1)) AS line, unnest(lines) AS raw FROM y), p AS (SELECT graph_id, line, regexp_split_to_array(trim(raw, ' '), '\\s+') AS p FROM l WHERE trim(raw, ' ') <> '')
    SELECT graph_id, line::INT AS line, CASE WHEN len(p) > 2 THEN 'expected one or two numbers' ELSE 'not a whole number' END AS message FROM p
    WHERE len(p) > 2 OR NOT regexp_full_match(p[1], '[+-]?[0-9]+') OR (len(p) = 2 AND NOT regexp_full_match(p[2], '[+-]?[0-9]+'))""")
def parse_errors(spark, sf_dir):
    return edge_lists.errors(texts(spark, sf_dir))


@query(f"WITH {graph('h')} SELECT graph_id, u, v FROM h_e")
def json_edges(spark, sf_dir):
    rows = h(spark, sf_dir)[1].groupBy("graph_id").agg(F.to_json(F.collect_list(F.array("u", "v"))).alias("text"))
    return edge_lists.parse_json(rows)[1]


@query(f"WITH {graph('t')} SELECT graph_id, string_agg(node_id || '=' || degree, ';' ORDER BY node_id) AS predictions FROM t_d GROUP BY graph_id")
def prediction_document(spark, sf_dir):
    found = layers.predict(*t(spark, sf_dir))
    documents = edge_lists.to_json(found, "graph_id", "predictions", "node_id")
    back = documents.select("graph_id", F.from_json("document", "predictions array<struct<node_id:bigint,true_degree:bigint,predicted_degree:double>>").alias("d"))
    return back.select("graph_id", F.array_join(F.transform("d.predictions", lambda x: F.concat_ws("=", x["node_id"].cast("string"), x["predicted_degree"].cast("bigint").cast("string"))), ";").alias("predictions"))


@query(f"WITH {graph('r')} SELECT graph_id, u, v FROM r_e")
def random_graph(spark, sf_dir):
    return r(spark, sf_dir)[1]


# --- bounds, girth, validation ----------------------------------------------------------


#: Pairs (k, g) that parts ask for by their size and key, some of them out of range.
ASKED = "a AS (SELECT DISTINCT (p_size % 7)::INT AS k, (p_partkey % 10)::INT AS g FROM part)"


def asked(spark, sf_dir):
    return projections.read(spark, sf_dir, "part").select((F.col("p_size") % 7).cast("int").alias("k"), (F.col("p_partkey") % 10).cast("int").alias("g")).distinct()


@query(f"""WITH {ASKED}, p AS (SELECT k, g, [(k - 1) ** i FOR i IN range(0, 12)] AS w FROM a WHERE k >= 2 AND g >= 3)
    SELECT k, g, (CASE WHEN g % 2 = 1 THEN 1 + k * list_sum(w[1:(g - 1) // 2]) ELSE 2 * list_sum(w[1:g // 2]) END)::BIGINT AS moore_bound, (4 * list_sum(w[2:g - 1]))::BIGINT AS upper_bound FROM p""")
def moore_bounds(spark, sf_dir):
    k, g = F.col("k"), F.col("g")
    return asked(spark, sf_dir).filter(bounds.valid_column(k, g)).select("k", "g", bounds.moore_column(k, g).alias("moore_bound"), bounds.upper_column(k, g).alias("upper_bound"))


@query(f"WITH RECURSIVE {graph('t')}, {sql.girth('t')} SELECT * FROM t_g")
def girth(spark, sf_dir):
    return cycles.girth(*t(spark, sf_dir))


@query(f"WITH RECURSIVE {graph('t')}, {sql.girth('t')} SELECT * FROM t_g WHERE girth IS NOT NULL")
def girth_levels(spark, sf_dir):
    return contraction.girths(t(spark, sf_dir)[1], contraction.LOCAL)


@query(f"WITH RECURSIVE {graph('h')}, {sql.girth('h')} SELECT * FROM h_g")
def girth_hand_off(spark, sf_dir):
    return cycles.girth(*h(spark, sf_dir))


@query("""WITH RECURSIVE e AS (SELECT n_regionkey::BIGINT AS u, (n_nationkey + 1000)::BIGINT AS v FROM nation),
    a AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
    part(node, root) USING KEY (node) AS (SELECT u, u FROM a UNION SELECT a.v, min(p.root) FROM part p JOIN a ON a.u = p.node JOIN recurring.part o ON o.node = a.v WHERE p.root < o.root GROUP BY a.v),
    n AS (SELECT (SELECT count(*) FROM part) AS vertices, (SELECT count(DISTINCT root) FROM part) AS parts, (SELECT count(*) FROM e) AS edges)
    SELECT 'forest' AS graph_id, CASE WHEN edges > vertices - parts THEN -1 END::INT AS girth FROM n""")
def girth_forest(spark, sf_dir):
    """Null, as in SQL by the number of edges, vertices and parts (customers hang on by one edge each)."""
    return cycles.girth(*projections.forest(spark, sf_dir))


@query(f"""WITH {graph("b")}, p AS (SELECT DISTINCT a.v AS x, b.v AS y, a.u FROM b_e a JOIN b_e b ON a.u = b.u AND a.v < b.v)
    SELECT 'supply' AS graph_id, 4 AS girth WHERE EXISTS (SELECT 1 FROM p GROUP BY x, y HAVING count(*) > 1)""")
def girth_supply(spark, sf_dir):
    """By contraction, whatever the size; the SQL only knows that two suppliers of the same two parts are a cycle."""
    return contraction.girths(projections.supply(spark, sf_dir)[1])


@query(f"""{FIGURES} SELECT graph_id, k, g, n AS num_nodes, m AS num_edges, girth, regular AS is_k_regular, regular AND coalesce(girth = g, false) AS is_valid_cage,
    mb AS moore_bound, regular AND coalesce(girth = g, false) AND n = mb AS is_optimal FROM t_f""")
def validate_cage(spark, sf_dir):
    return validate.validate(*t(spark, sf_dir), wanted(spark, sf_dir))


# --- candidates and scores --------------------------------------------------------------

CANDIDATES = f"""{graph("h")}, low AS (SELECT graph_id, node_id, degree FROM h_d WHERE degree < 3),
    p AS (SELECT a.graph_id, a.node_id AS u, b.node_id AS v FROM low a JOIN low b ON a.graph_id = b.graph_id AND a.node_id < b.node_id)"""


@query(f"WITH {CANDIDATES} SELECT p.graph_id, p.u, p.v FROM p ANTI JOIN h_e e ON e.graph_id = p.graph_id AND e.u = p.u AND e.v = p.v")
def candidate_pairs(spark, sf_dir):
    return candidates.pairs(*h(spark, sf_dir), 3).select("graph_id", "u", "v")


SAFE = f"""WITH RECURSIVE {sql.figures("t", WANTED)}, {sql.distance("t")},
    low AS (SELECT d.graph_id, d.node_id, d.degree FROM t_d d WHERE d.degree < {K}),
    p AS (SELECT a.graph_id, a.node_id AS u, b.node_id AS v, a.degree AS du, b.degree AS dv FROM low a JOIN low b ON a.graph_id = b.graph_id AND a.node_id < b.node_id),
    s AS (SELECT p.*, w.distance FROM p LEFT JOIN t_w w ON w.graph_id = p.graph_id AND w.src = p.u AND w.dst = p.v WHERE coalesce(w.distance, 999999) > {G - 2})"""


@query(f"{SAFE} SELECT graph_id, u, v FROM s")
def girth_safe_pairs(spark, sf_dir):
    vertices, edges = t(spark, sf_dir)
    return candidates.safe_pairs(vertices, edges, K, G).select("graph_id", "u", "v")


ADDED = f"""{SAFE}, e AS (SELECT s.graph_id, s.u, s.v, f.*, du, dv, (f.share * n + CASE WHEN du + 1 = k THEN 1 WHEN du + 1 = k + 1 THEN -1 ELSE 0 END + CASE WHEN dv + 1 = k THEN 1 WHEN dv + 1 = k + 1 THEN -1 ELSE 0 END) / n AS done,
        least(f.girth, s.distance + 1) AS cycle FROM s JOIN t_f f ON f.graph_id = s.graph_id),
    x AS (SELECT graph_id, u, v, {quality("done", "cycle")} + CASE WHEN du + 1 = k THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN dv + 1 = k THEN 0.2::DOUBLE ELSE 0 END AS score FROM e)"""
VERTEX = "CASE WHEN n < mb THEN 1.0::DOUBLE WHEN n = mb THEN 0.5::DOUBLE ELSE greatest(0.0::DOUBLE, 0.3::DOUBLE - 0.1::DOUBLE * (n - mb)) END"


@query(f"{ADDED} SELECT graph_id, u, v, round(score, 9) AS score FROM x")
def score_add_edge(spark, sf_dir):
    rows = held(figures(spark, sf_dir), "figures")
    return candidates.scored_edges(*t(spark, sf_dir), K, G, rows, digits=9)


@query(f"{FIGURES} SELECT graph_id, round({VERTEX}, 9) AS score FROM t_f")
def score_add_vertex(spark, sf_dir):
    return figures(spark, sf_dir).select("graph_id", F.round(score.add_vertex(F.col("n"), F.col("mb")), 9).alias("score"))


@query(f"""{ADDED}, a AS (SELECT graph_id, 'add_edge' AS type, u, v, round(score, 9) AS score FROM x UNION ALL SELECT graph_id, 'add_vertex', NULL, NULL, round({VERTEX}, 9) FROM t_f WHERE n < 2 * mb)
    SELECT graph_id, type, u, v, score FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY score DESC, (type = 'add_edge') DESC, u DESC NULLS LAST, v DESC NULLS LAST) AS place FROM a) WHERE place = 1""")
def greedy_action(spark, sf_dir):
    """Of each kind of pair only the last one is scored: among pairs of equal score it is the one taken."""
    rows = held(figures(spark, sf_dir), "figures")
    edges = candidates.last_edges(*t(spark, sf_dir), K, G, rows)
    return candidates.greedy(candidates.actions(edges, rows).withColumn("score", F.round("score", 9)))


@query(f"{FIGURES} SELECT graph_id, round(0.3 * {quality('share', 'girth')} + 0.3 * share + 0.15 * {near('n', 'mb')} + 0.15 * {near('m', '(n * k // 2)')} + 0.1 * {term('girth')}, 9) AS score FROM t_f")
def score_astar(spark, sf_dir):
    c = F.col
    return figures(spark, sf_dir).select("graph_id", F.round(score.best_first(c("n"), c("m"), c("share"), c("girth"), c("mb"), c("k"), c("g")), 9).alias("score"))


@query(f"""{FIGURES} SELECT graph_id, round(0.3 * share + 0.3 * least(n / mb::DOUBLE, 1) + 0.3 * e + 0.1 * CASE WHEN girth IS NULL THEN 0.4 + 0.3 * e WHEN girth < g THEN 0.1 WHEN girth = g THEN 1 ELSE 0.6 END, 9) AS score
    FROM (SELECT *, least(m / (n * k / 2::DOUBLE), 1) AS e FROM t_f)""")
def score_mcts(spark, sf_dir):
    c = F.col
    return figures(spark, sf_dir).select("graph_id", F.round(score.tree_search(c("n"), c("m"), c("share"), c("girth"), c("mb"), c("k"), c("g")), 9).alias("score"))


@query("""WITH c AS (SELECT o_custkey AS parent, o_orderkey AS child, o_orderkey % 5 AS visits, (o_orderkey % 5) * (o_orderkey % 97) / 97::DOUBLE AS value FROM orders),
    p AS (SELECT parent, sum(visits) + 1 AS total FROM c GROUP BY parent),
    s AS (SELECT c.parent, child, CASE WHEN visits > 0 THEN value / visits + 0.5 * sqrt(2 * ln(total) / visits) ELSE 'Infinity'::DOUBLE END AS b FROM c JOIN p USING (parent))
    SELECT parent, child FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY b DESC, child) AS place FROM s) WHERE place = 1""")
def ucb1_best(spark, sf_dir):
    o = projections.read(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("child"), (F.col("o_orderkey") % 5).alias("visits"), ((F.col("o_orderkey") % 5) * (F.col("o_orderkey") % 97) / 97).alias("value"))
    total = rows.groupBy("parent").agg((F.sum("visits") + 1).alias("parent_visits"))
    return candidates.best_child(rows.join(total, "parent"))


POLICY = f"""{FIGURES}, s AS (SELECT *, n * k // 2 - m AS deficit, n < mb AS under, n > mb AS over FROM t_f),
    w AS (SELECT graph_id, CASE WHEN high > 0 THEN [0, .15, .8, 0, .05]
        WHEN deficit > 0 AND low >= 2 THEN [.75, .1, 0, CASE WHEN under THEN .1 ELSE 0 END, CASE WHEN over THEN .05 ELSE 0 END]
        WHEN deficit < 0 THEN [0, .7, 0, CASE WHEN under THEN .1 ELSE 0 END, CASE WHEN over THEN .2 ELSE 0 END]
        WHEN low = 1 THEN [.1, .5, 0, CASE WHEN under THEN .15 ELSE 0 END, .25]
        ELSE [.25, .4, 0, CASE WHEN under THEN .15 ELSE .05 END, CASE WHEN over THEN .2 ELSE .1 END] END AS w FROM s),
    l AS (SELECT graph_id, unnest(range(5)) AS ordinal, unnest(['add_edge', 'remove_edge', 'remove_edge_high', 'add_vertex', 'remove_vertex']) AS action, unnest(w)::DOUBLE AS w FROM w),
    q AS (SELECT graph_id, ordinal, action, w / sum(w) OVER (PARTITION BY graph_id) AS p FROM l WHERE w > 0)"""


@query(f"{POLICY} SELECT graph_id, action, round(p, 9) AS p FROM q")
def policy_table(spark, sf_dir):
    return candidates.policies(figures(spark, sf_dir)).select("graph_id", "action", F.round("p", 9).alias("p"))


@query(f"""{POLICY}, c AS (SELECT graph_id, ordinal, action, sum(p) OVER (PARTITION BY graph_id ORDER BY ordinal) AS up_to FROM q)
    SELECT graph_id, arg_min(action, ordinal) AS action FROM c WHERE up_to > {sql.uniform("'7:' || graph_id")} GROUP BY graph_id""")
def weighted_choice(spark, sf_dir):
    return candidates.weighted_choice(candidates.policies(figures(spark, sf_dir)), seed=7)


# --- fingerprints and frontier ----------------------------------------------------------


def refined(x: str, rounds: int) -> str:
    out = f"{graph(x)}, l0 AS (SELECT graph_id, node_id, degree::VARCHAR AS label FROM {x}_d)"
    for i in range(rounds):
        out += f""", l{i + 1} AS (SELECT l.graph_id, l.node_id, md5(any_value(l.label) || coalesce(string_agg(m.label, '' ORDER BY m.label), '')) AS label
            FROM l{i} l LEFT JOIN {x}_a a ON a.graph_id = l.graph_id AND a.src = l.node_id LEFT JOIN l{i} m ON m.graph_id = l.graph_id AND m.node_id = a.dst GROUP BY l.graph_id, l.node_id)"""
    return f"{out}, w AS (SELECT graph_id, md5(string_agg(label, '' ORDER BY label)) AS fingerprint FROM l{rounds} GROUP BY graph_id)"


@query(f"WITH {refined('h', 2)} SELECT * FROM w")
def wl_fingerprint(spark, sf_dir):
    return fingerprint.wl_hash(*h(spark, sf_dir), rounds=2)


@query(f"WITH {graph('t')} SELECT graph_id, md5(string_agg(u || '-' || v, ',' ORDER BY u, v)) AS fingerprint FROM t_e GROUP BY graph_id")
def edge_fingerprint(spark, sf_dir):
    return fingerprint.edge_hash(t(spark, sf_dir)[1])


@query(f"WITH {refined('t', 3)} SELECT w.fingerprint, min(w.graph_id) AS graph_id FROM w WHERE w.fingerprint NOT IN (SELECT x.fingerprint FROM w x WHERE x.graph_id LIKE '____-__-01 %') GROUP BY w.fingerprint")
def visited_dedup(spark, sf_dir):
    states = fingerprint.wl_hash(*t(spark, sf_dir))
    return fingerprint.unseen(states, states.filter(F.col("graph_id").like("____-__-01 %")))


@query("SELECT o_orderkey AS counter, o_totalprice AS score FROM orders ORDER BY score DESC, counter LIMIT 10")
def frontier_topk(spark, sf_dir):
    o = projections.read(spark, sf_dir, "orders")
    return fingerprint.best(o.select(F.col("o_orderkey").alias("counter"), F.col("o_totalprice").alias("score")), 10)


@query("SELECT session, counter, row_number() OVER (PARTITION BY session ORDER BY score DESC, counter) AS place FROM (SELECT o_custkey AS session, o_orderkey AS counter, o_totalprice AS score FROM orders)")
def frontier_order(spark, sf_dir):
    o = projections.read(spark, sf_dir, "orders")
    rows = fingerprint.ranked(o.select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("counter"), F.col("o_totalprice").alias("score")))
    return rows.select("session", "counter", "place")


# --- edits ------------------------------------------------------------------------------


@query(f"""WITH {graph("h")}, y AS (SELECT strftime(strptime(graph_id, '%Y-%m-%d') - INTERVAL 1 DAY, '%Y-%m-%d') AS graph_id, u, v FROM h_e)
    (SELECT * FROM h_e EXCEPT SELECT * FROM y) UNION ALL (SELECT * FROM y EXCEPT SELECT * FROM h_e)""")
def edge_toggle(spark, sf_dir):
    edges = h(spark, sf_dir)[1]
    return edits.toggle(edges, edges.withColumn("graph_id", F.date_format(F.date_sub(F.to_date("graph_id"), 1), "yyyy-MM-dd")))


GONE = "x AS (SELECT graph_id, max(node_id) AS node_id FROM h_v GROUP BY graph_id)"


@query(f"WITH {graph('h')}, {GONE} SELECT e.* FROM h_e e JOIN x USING (graph_id) WHERE u <> node_id AND v <> node_id")
def vertex_remove(spark, sf_dir):
    vertices, edges = h(spark, sf_dir)
    return edits.remove_vertices(vertices, edges, vertices.groupBy("graph_id").agg(F.max("node_id").alias("node_id")))[1]


@query(f"WITH {graph('h')} SELECT * FROM h_v UNION ALL SELECT graph_id, max(node_id) + 1 FROM h_v GROUP BY graph_id")
def vertex_add(spark, sf_dir):
    return edits.add_vertex(h(spark, sf_dir)[0])


@query(f"WITH {graph('t')} SELECT graph_id, u, v FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY {sql.uniform(chr(39) + '3:' + chr(39) + ' || graph_id || ' + chr(39) + ':' + chr(39) + ' || u || ' + chr(39) + ':' + chr(39) + ' || v')}, u, v) AS place FROM t_e) WHERE place > 1")
def edge_remove_random(spark, sf_dir):
    return edits.remove_random_edge(t(spark, sf_dir)[1], seed=3)


# --- model ------------------------------------------------------------------------------

WEIGHTS = ([[0.5, -0.25], [0.125, 0.75]], [[1.0, 0.5], [-0.5, 0.25]], [0.1, -0.2])


def simple(spark, sf_dir):
    vertices, edges = h(spark, sf_dir)
    return vertices.withColumn("features", F.array((F.col("node_id") % 7).cast("double"), (F.col("node_id") % 3).cast("double"))), edges


SIMPLE = f"""{graph("h")}, z AS (SELECT graph_id, node_id, (node_id % 7)::DOUBLE AS x0, (node_id % 3)::DOUBLE AS x1 FROM h_v),
    s AS (SELECT v.graph_id, v.node_id, coalesce(sum(z.x0), 0) AS s0, coalesce(sum(z.x1), 0) AS s1 FROM h_v v LEFT JOIN h_a a ON a.graph_id = v.graph_id AND a.src = v.node_id LEFT JOIN z ON z.graph_id = a.graph_id AND z.node_id = a.dst GROUP BY v.graph_id, v.node_id)"""


@query(f"WITH {SIMPLE} SELECT * FROM s")
def neighbor_sum(spark, sf_dir):
    found = layers.neighbor_sum(*simple(spark, sf_dir), 2)
    return found.select("graph_id", "node_id", F.col("near")[0].alias("s0"), F.col("near")[1].alias("s1"))


@query(f"WITH {SIMPLE} SELECT z.graph_id, z.node_id, round(0.5 * s0 - 0.25 * s1 + 0.1 + x0 + 0.5 * x1, 9) AS y0, round(0.125 * s0 + 0.75 * s1 - 0.2 - 0.5 * x0 + 0.25 * x1, 9) AS y1 FROM z JOIN s USING (graph_id, node_id)")
def sage_layer(spark, sf_dir):
    found = layers.sage(*simple(spark, sf_dir), *WEIGHTS)
    return found.select("graph_id", "node_id", F.round(F.col("features")[0], 9).alias("y0"), F.round(F.col("features")[1], 9).alias("y1"))


@query(f"WITH {SIMPLE} SELECT 0 AS dim, round(avg(x0), 9) AS mean, round(var_pop(x0), 9) AS var FROM z UNION ALL SELECT 1, round(avg(x1), 9), round(var_pop(x1), 9) FROM z")
def batch_norm(spark, sf_dir):
    return layers.batch_figures(simple(spark, sf_dir)[0], 2).select("dim", F.round("mean", 9).alias("mean"), F.round("var", 9).alias("var"))


@query(f"WITH {graph('h')} SELECT graph_id, node_id, degree AS true_degree, degree::DOUBLE AS predicted_degree FROM h_d")
def predict_fallback(spark, sf_dir):
    return layers.predict(*h(spark, sf_dir))


def guessed(spark, sf_dir):
    """Predictions from made-up scores: the degree with a deterministic error."""
    vertices, edges = h(spark, sf_dir)
    scores = metrics.degrees(vertices, edges).select("graph_id", "node_id", (F.col("degree") + basic.uniform(F.col("graph_id"), F.col("node_id")) * 2 - 1).alias("score"))
    return layers.predict(vertices, edges, scores)


GUESS = f"{graph('h')}, p AS (SELECT graph_id, node_id, degree, greatest(0, round_even((degree + {sql.uniform(chr(39).join(['graph_id || ', ':', ' || node_id']))} * 2 - 1)::DOUBLE, 0)) AS guess FROM h_d)"


@query(f"WITH {GUESS} SELECT graph_id, node_id, degree AS true_degree, guess::DOUBLE AS predicted_degree FROM p")
def predict_rounded(spark, sf_dir):
    return guessed(spark, sf_dir)


@query(f"""WITH {GUESS}, g AS (SELECT graph_id, avg((guess - degree) * (guess - degree)) AS mse, avg(abs(guess - degree)) AS mae, count(*) FILTER (guess = degree) AS right_n, count(*) AS n FROM p GROUP BY graph_id)
    SELECT round(avg(mse), 9) AS mse, round(avg(mae), 9) AS mae, round(100.0::DOUBLE * sum(right_n)::DOUBLE / sum(n)::DOUBLE, 9) AS accuracy FROM g""")
def eval_metrics(spark, sf_dir):
    return layers.evaluate(guessed(spark, sf_dir)).select(*(F.round(c, 9).alias(c) for c in ("mse", "mae", "accuracy")))


# --- histories and reports --------------------------------------------------------------


@query("""WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, max(value) AS top FROM events GROUP BY day), b AS (SELECT *, max(top) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM d)
    SELECT day, top, best_before, coalesce(top > best_before, true) AS is_best FROM b""")
def running_best(spark, sf_dir):
    days = projections.read(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.max("value").alias("top"))
    return history.running_best(days, "day", "top")


@query("SELECT event_id, value FROM events WHERE event_id % 100 = 0")
def every_n(spark, sf_dir):
    return history.every(projections.read(spark, sf_dir, "events").select("event_id", "value"), "event_id", 100)


@query("""SELECT generator, count(*) AS runs, count(*) FILTER (success) AS successes, round(avg(success::INT::DOUBLE), 9) AS success_rate, round(avg(CASE WHEN success THEN steps END), 9) AS mean_steps,
    median(CASE WHEN success THEN steps END)::DOUBLE AS median_steps FROM (SELECT o_orderpriority AS generator, o_orderstatus = 'F' AS success, o_orderkey % 1000 AS steps FROM orders) GROUP BY generator""")
def results_summary(spark, sf_dir):
    o = projections.read(spark, sf_dir, "orders")
    found = search.summary(o.select(F.col("o_orderpriority").alias("generator"), (F.col("o_orderstatus") == "F").alias("success"), (F.col("o_orderkey") % 1000).alias("steps")))
    return found.withColumns({c: F.round(c, 9) for c in ("success_rate", "mean_steps")})


@query(f"""WITH RECURSIVE {graph("f")}, t AS (SELECT v AS node, u AS parent FROM f_e UNION ALL SELECT r_regionkey::BIGINT, NULL FROM region),
    a(node, ancestor) AS (SELECT node, node FROM t UNION ALL SELECT a.node, t.parent FROM a JOIN t ON t.node = a.ancestor WHERE t.parent IS NOT NULL)
    SELECT ancestor AS node, count(*) AS visits, sum(node % 10)::BIGINT AS value FROM a WHERE node >= {projections.CUSTOMER} GROUP BY ancestor""")
def backprop(spark, sf_dir):
    vertices, edges = projections.forest(spark, sf_dir)
    tree = vertices.select(F.col("node_id").alias("node")).join(edges.select(F.col("v").alias("node"), F.col("u").alias("parent")), "node", "left")
    leaves = tree.filter(F.col("node") >= projections.CUSTOMER).select("node", (F.col("node") % 10).alias("reward"))
    return trees.propagate(tree, leaves)


# --- layout -----------------------------------------------------------------------------

PLACED = f"""{graph("t")}, i AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS idx, count(*) OVER (PARTITION BY graph_id) AS n FROM t_v),
    pos AS (SELECT graph_id, node_id, 200 * cos(idx / n::DOUBLE * (2 * pi()) - pi() / 2) AS x, 200 * sin(idx / n::DOUBLE * (2 * pi()) - pi() / 2) AS y FROM i),
    pr AS (SELECT a.graph_id, a.node_id AS src, b.node_id AS dst, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS d FROM pos a JOIN pos b ON a.graph_id = b.graph_id AND a.node_id <> b.node_id),
    nb AS (SELECT pr.*, (e.src IS NOT NULL) AS joined FROM pr LEFT JOIN (SELECT DISTINCT * FROM t_a) e ON e.graph_id = pr.graph_id AND e.src = pr.src AND e.dst = pr.dst)"""


def rounded_places(df):
    return df.select("graph_id", "node_id", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


@query(f"WITH {PLACED} SELECT graph_id, node_id, round(x, 6) + 0.0::DOUBLE AS x, round(y, 6) + 0.0::DOUBLE AS y FROM pos")
def layout_circle(spark, sf_dir):
    return rounded_places(layout.circle(t(spark, sf_dir)[0]))


@query(f"""WITH {PLACED}, f AS (SELECT graph_id, src AS node_id, sum(0.1 * (d - 300) * dx / d) AS fx, sum(0.1 * (d - 300) * dy / d) AS fy FROM nb WHERE d >= 0.1 AND (joined OR d <= 900) GROUP BY ALL)
    SELECT graph_id, node_id, round(x + greatest(-5, least(5, coalesce(fx, 0) * 0.1667)), 6) + 0.0::DOUBLE AS x, round(y + greatest(-5, least(5, coalesce(fy, 0) * 0.1667)), 6) + 0.0::DOUBLE AS y FROM pos LEFT JOIN f USING (graph_id, node_id)""")
def layout_step_spring(spark, sf_dir):
    vertices, edges = t(spark, sf_dir)
    return rounded_places(layout.spring_step(layout.circle(vertices), edges))


@query(f"""WITH {PLACED}, f AS (SELECT graph_id, src AS node_id, sum(((CASE WHEN joined THEN 0.05 * (d - 100) ELSE 0 END) - 3000 / (d * d)) * dx / d) AS fx, sum(((CASE WHEN joined THEN 0.05 * (d - 100) ELSE 0 END) - 3000 / (d * d)) * dy / d) AS fy FROM nb WHERE d >= 0.1 GROUP BY ALL)
    SELECT graph_id, node_id, round(x + 0.85 * (coalesce(fx, 0) - 0.001 * x), 6) + 0.0::DOUBLE AS x, round(y + 0.85 * (coalesce(fy, 0) - 0.001 * y), 6) + 0.0::DOUBLE AS y FROM pos LEFT JOIN f USING (graph_id, node_id)""")
def layout_step_legacy(spark, sf_dir):
    vertices, edges = t(spark, sf_dir)
    return rounded_places(layout.legacy_step(layout.circle(vertices), edges))


@query(f"WITH {PLACED} SELECT graph_id, max(node_id) AS node_id FROM pos WHERE sqrt(x * x + (y + 200) * (y + 200)) <= 60 GROUP BY graph_id")
def hit_test(spark, sf_dir):
    return layout.hit(layout.circle(t(spark, sf_dir)[0]), 0.0, -200.0, 60.0)


# --- sessions ---------------------------------------------------------------------------


@query("SELECT user_id, event_id, round(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 3) AS gap FROM events")
def session_gaps(spark, sf_dir):
    events = projections.read(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return session.gaps(events, "user_id", "ts", "event_id").select("user_id", "event_id", F.round("gap", 3).alias("gap"))


@query("SELECT user_id, round((SELECT epoch(max(ts)) FROM events) - epoch(max(ts)), 3) AS idle FROM events GROUP BY user_id HAVING (SELECT epoch(max(ts)) FROM events) - epoch(max(ts)) > 86400")
def abandoned_sessions(spark, sf_dir):
    events = projections.read(spark, sf_dir, "events").select("user_id", "ts")
    now = events.agg(F.max("ts")).scalar()
    return session.abandoned(events, "user_id", "ts", now, 86_400).select("user_id", F.round("idle", 3).alias("idle"))


# --- searches: random, so rows only -----------------------------------------------------


def searched(spark, name):
    return run(targets(spark), [name]).drop("time_seconds", "edges")


@query()
def search_walk(spark, sf_dir):
    return searched(spark, "randomwalk")


@query()
def search_dfs(spark, sf_dir):
    return searched(spark, "bruteforce")


@query()
def search_astar(spark, sf_dir):
    return searched(spark, "astar")


@query()
def search_mcts(spark, sf_dir):
    return searched(spark, "mcts")


from . import details  # noqa: E402, F401  it registers its queries here
