"""Table schemas and names that all parts share.

Graphs are rows of two tables keyed by ``graph_id``; an edge is one row with ``u <= v``.
"""

VERTICES = "graph_id string, node_id bigint"
EDGES = "graph_id string, u bigint, v bigint"
PREDICTIONS = "graph_id string, node_id bigint, true_degree bigint, predicted_degree double"
VALIDATION = "graph_id string, k int, g int, num_nodes bigint, num_edges bigint, girth int, is_k_regular boolean, is_valid_cage boolean, moore_bound bigint, is_optimal boolean"
STATUS = (
    "session_id string, k int, g int, step_count bigint, num_nodes bigint, num_edges bigint, girth int, is_k_regular boolean, "
    "is_complete boolean, success boolean, stopped boolean, current_graph string, moore_bound bigint, elapsed_time double"
)
SEARCH_RESULT = "k int, g int, name string, generator string, walker int, success boolean, steps bigint, final_n bigint, final_girth double, time_seconds double, error string, explored bigint, duplicates bigint, edges array<struct<u:bigint,v:bigint>>"
MODEL_INFO = "last_updated string, epoch bigint, hidden_dim bigint, learning_rate double, metrics struct<mean_squared_error:double,mean_absolute_error:double,accuracy:double>, model_path string"

# The search targets (suite, k, g, name, known smallest order).
TARGETS = (
    ("small", 3, 5, "Petersen graph", 10),
    ("small", 3, 6, "Heawood graph", 14),
    ("small", 4, 5, "(4,5)-cage", 19),
    ("medium", 3, 7, "McGee graph", 24),
    ("medium", 3, 8, "Tutte-Coxeter", 30),
    ("medium", 5, 5, "(5,5)-cage", 30),
    ("large", 3, 9, "(3,9)-cage", 58),
    ("large", 4, 6, "(4,6)-cage", 26),
)

# Request defaults and timeouts in seconds.
RANDOM_GRAPH = {"min_nodes": 5, "max_nodes": 12, "min_prob": 0.15, "max_prob": 0.60, "self_loop_prob": 0.1}
ABANDON_AFTER, EVICT_AFTER, EVICT_EVERY, MAX_STEPS = 5, 30, 10, 10_000
