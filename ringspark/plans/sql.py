"""SQL for the graph projections and figures, as common table expressions."""

from __future__ import annotations

from ringspark.sources.projections import CUSTOMER, NATION, SUPPLIER

WIDTH, SPREAD = 12 - 5 + 1, 0.60 - 0.15


def uniform(text: str) -> str:
    return f"(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE))"


#: The vertices (x_v) and edges (x_e) of each projection.
PROJECTIONS = {
    "t": """t_v AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d %H') AS graph_id, user_id AS node_id FROM events),
        t_e AS (SELECT DISTINCT graph_id, least(a, b) AS u, greatest(a, b) AS v FROM (
            SELECT strftime(ts, '%Y-%m-%d %H') AS graph_id, user_id AS a,
                   lead(user_id) OVER (PARTITION BY strftime(ts, '%Y-%m-%d %H') ORDER BY ts, event_id) AS b FROM events)
            WHERE b IS NOT NULL)""",
    "h": """h_v AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS graph_id, user_id AS node_id FROM events),
        h_e AS (SELECT DISTINCT graph_id, least(a, b) AS u, greatest(a, b) AS v FROM (
            SELECT strftime(ts, '%Y-%m-%d') AS graph_id, user_id AS a,
                   lead(user_id) OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS b FROM events)
            WHERE b IS NOT NULL)""",
    "b": f"""b_v AS (SELECT 'supply' AS graph_id, p_partkey AS node_id FROM part UNION ALL SELECT 'supply', s_suppkey + {SUPPLIER} FROM supplier),
        b_e AS (SELECT DISTINCT 'supply' AS graph_id, l_partkey AS u, l_suppkey + {SUPPLIER} AS v FROM lineitem)""",
    "n": """n_v AS (SELECT 'trade' AS graph_id, CAST(n_nationkey AS BIGINT) AS node_id FROM nation),
        n_e AS (SELECT DISTINCT 'trade' AS graph_id, CAST(least(c_nationkey, s_nationkey) AS BIGINT) AS u, CAST(greatest(c_nationkey, s_nationkey) AS BIGINT) AS v
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)""",
    "f": f"""f_e AS (SELECT 'forest' AS graph_id, CAST(n_regionkey AS BIGINT) AS u, CAST(n_nationkey + {NATION} AS BIGINT) AS v FROM nation
            UNION ALL SELECT 'forest', CAST(c_nationkey + {NATION} AS BIGINT), CAST(c_custkey + {CUSTOMER} AS BIGINT) FROM customer),
        f_v AS (SELECT 'forest' AS graph_id, CAST(r_regionkey AS BIGINT) AS node_id FROM region UNION ALL SELECT graph_id, v FROM f_e)""",
    "r": f"""r_i AS (SELECT i, 5 + CAST(floor({uniform("'0:' || i || ':n'")} * {WIDTH}) AS BIGINT) AS n, CAST(0.15 AS DOUBLE) + {uniform("'0:' || i || ':p'")} * CAST({SPREAD!r} AS DOUBLE) AS p FROM (SELECT s_suppkey AS i FROM supplier)),
        r_n AS (SELECT 'r' || i AS graph_id, i, n, p, unnest(range(n)) AS u FROM r_i),
        r_v AS (SELECT graph_id, u AS node_id FROM r_n),
        r_e AS (SELECT graph_id, u, v FROM (SELECT graph_id, i, p, u, unnest(range(u, n)) AS v FROM r_n)
            WHERE {uniform("'0:' || i || ':' || u || ':' || v")} < CASE WHEN u = v THEN CAST(0.1 AS DOUBLE) ELSE p END)""",
}


def graph(x: str) -> str:
    """Projection x with its adjacency (x_a), degrees (x_d) and counts (x_c)."""
    return f"""{PROJECTIONS[x]},
        {x}_a AS (SELECT graph_id, u AS src, v AS dst FROM {x}_e UNION ALL SELECT graph_id, v, u FROM {x}_e),
        {x}_d AS (SELECT v.graph_id, v.node_id, count(a.src) AS degree FROM {x}_v v LEFT JOIN {x}_a a ON a.graph_id = v.graph_id AND a.src = v.node_id GROUP BY v.graph_id, v.node_id),
        {x}_c AS (SELECT v.graph_id, v.n AS num_nodes, coalesce(e.m, 0) AS num_edges FROM (SELECT graph_id, count(*) AS n FROM {x}_v GROUP BY graph_id) v
            LEFT JOIN (SELECT graph_id, count(*) AS m FROM {x}_e GROUP BY graph_id) e USING (graph_id))"""


def distance(x: str) -> str:
    """Distances (x_w) of different vertices that a path joins."""
    return f"""{x}_b(graph_id, src, dst, d) USING KEY (graph_id, src, dst) AS (
            SELECT graph_id, node_id, node_id, 0 FROM {x}_v
            UNION SELECT DISTINCT b.graph_id, b.src, a.dst, b.d + 1 FROM {x}_b b JOIN {x}_a a ON a.graph_id = b.graph_id AND a.src = b.dst
                WHERE NOT EXISTS (SELECT 1 FROM recurring.{x}_b o WHERE o.graph_id = b.graph_id AND o.src = b.src AND o.dst = a.dst)),
        {x}_w AS (SELECT graph_id, src, dst, d AS distance FROM {x}_b WHERE src <> dst)"""


def girth(x: str) -> str:
    """Girths (x_g), whatever their length: an edge and the shortest way around it."""
    return f"""{x}_y(graph_id, u, v, node, d) USING KEY (graph_id, u, v, node) AS (
            SELECT graph_id, u, v, u, 0 FROM {x}_e WHERE u < v
            UNION SELECT DISTINCT y.graph_id, y.u, y.v, a.dst, y.d + 1 FROM {x}_y y JOIN {x}_a a ON a.graph_id = y.graph_id AND a.src = y.node
                WHERE y.node <> y.v AND NOT (a.src = y.u AND a.dst = y.v) AND NOT (a.src = y.v AND a.dst = y.u)
                AND NOT EXISTS (SELECT 1 FROM recurring.{x}_y o WHERE o.graph_id = y.graph_id AND o.u = y.u AND o.v = y.v AND o.node = a.dst)),
        {x}_z AS (SELECT graph_id, min(d) + 1 AS girth FROM {x}_y WHERE node = v GROUP BY graph_id
            UNION ALL SELECT graph_id, 1 FROM {x}_e WHERE u = v),
        {x}_g AS (SELECT v.graph_id, CAST(min(z.girth) AS INT) AS girth FROM {x}_v v LEFT JOIN {x}_z z USING (graph_id) GROUP BY v.graph_id)"""


def figures(x: str, targets: str) -> str:
    """Figures (x_f) of the graphs; targets: a relation (graph_id, k, g, mb)."""
    return f"""{graph(x)}, {girth(x)}, {x}_t AS ({targets}),
        {x}_f AS (SELECT t.graph_id, t.k, t.g, t.mb, c.num_nodes AS n, c.num_edges AS m, g.girth, d.share, d.low, d.high, d.regular
            FROM {x}_t t JOIN {x}_c c USING (graph_id) JOIN {x}_g g USING (graph_id) JOIN (
                SELECT d.graph_id, avg(CASE WHEN degree = k THEN 1.0::DOUBLE ELSE 0 END) AS share, count(*) FILTER (degree < k) AS low,
                       count(*) FILTER (degree > k) AS high, bool_and(degree = k) AS regular
                FROM {x}_d d JOIN {x}_t t USING (graph_id) GROUP BY d.graph_id) d USING (graph_id))"""


NEAR = "(CASE WHEN greatest({a}, {b}) > 0 THEN 1 - abs({a} - {b}) / greatest({a}, {b})::DOUBLE ELSE 0.0::DOUBLE END)"
TERM = "(CASE WHEN {c} = g THEN 1.0::DOUBLE WHEN {c} IS NULL OR {c} > g THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END)"


def near(a: str, b: str) -> str:
    return NEAR.format(a=a, b=b)


def term(c: str) -> str:
    return TERM.format(c=c)


def quality(share: str, cycle: str) -> str:
    return f"(({share} + {near('n', 'mb')} + {term(cycle)}) / 3)"
