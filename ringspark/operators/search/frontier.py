"""Best-first and depth-first search as tables: many sessions at once, a round for each expansion.

A state is a row: the edit that led to it from its parent, its figures, its score and a
fingerprint.  Figures and fingerprints follow from the parent's and the edit, so only states that
are expanded ever have their edges written.  A round takes the best states of each session, joins
them with their parents' edges, lists the edges that close no short cycle and a new vertex, and
drops what has a fingerprint met before.  Depth first, the states are a stack: the newest round's
come first, by the score of the edit that made them, and nothing is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringspark.functions import bounds, score
from ringspark.operators import candidates, distances, multisets, validate
from ringspark.operators.lineage import held, under

PRINT = ["session", "n", "a", "b"]
STATE = ["session", "parent", "kind", "u", "v", "n", "m", "done", "girth", "a", "b", "round", "place", "score"]
#: Dozens of joins of tables that grow with the sessions: each that is broadcast goes through the driver.
SHUFFLED = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
PACK = 8  # rounds after which the tables of all rounds become one


@dataclass
class Outcome:
    """sessions: (session, success, explored, duplicates, state); frontier: states not yet expanded;
    nodes, links: (state, node_id), (state, u, v) of the states expanded that others still build on."""

    sessions: DataFrame
    frontier: DataFrame
    nodes: DataFrame
    links: DataFrame


def together(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def scored(rows: DataFrame, k: int, g: int, deep: bool = False) -> DataFrame:
    """Scores of states, or of the edits that led to them; ``more`` is how many vertices an edge made full."""
    share, mb = F.when(F.col("n") > 0, F.col("done") / F.col("n")).otherwise(0.0), F.lit(bounds.moore(k, g))
    value = score.best_first(F.col("n"), F.col("m"), share, F.col("girth"), mb, F.lit(k), F.lit(g))
    if deep:
        joined = score.quality(F.col("n"), share, F.col("girth"), mb, F.lit(g)) + 0.2 * F.col("more")
        value = F.when(F.col("kind") == "vertex", score.add_vertex(F.col("n") - 1, mb)).otherwise(joined)
    return rows.withColumn("score", F.round(value, 9)).select(STATE)


def start(vertices: DataFrame, edges: DataFrame, k: int, g: int) -> DataFrame:
    """The first frontier: each graph as a state of its own session."""
    own = vertices.select("graph_id").distinct()
    rows = validate.figures(vertices, edges, own.select("graph_id", F.lit(k).alias("k"), F.lit(g).alias("g"))).join(multisets.of_edges(vertices, edges), "graph_id")
    none = F.lit(None).cast("bigint")
    rows = rows.select(F.col("graph_id").alias("session"), F.concat(F.col("graph_id"), F.lit("/start")).alias("parent"), F.lit("start").alias("kind"), none.alias("u"), none.alias("v"), F.col("n").cast("bigint").alias("n"), F.col("m").cast("bigint").alias("m"),
                       F.round(F.col("share") * F.col("n")).cast("bigint").alias("done"), F.col("girth").cast("bigint").alias("girth"), "a", "b", F.lit(0).alias("round"), F.lit(0).alias("place"), F.lit(0).alias("more"))
    return scored(rows, k, g)


def graphs(taken: DataFrame, nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the states taken, by graph_id = state: the parent's and what the edit adds."""
    by = taken.select(F.col("state").alias("graph_id"), F.col("parent").alias("state"), "kind", "u", "v")
    old = by.select("graph_id", "state")
    vertices = old.join(nodes, "state").select("graph_id", "node_id").union(by.filter("kind = 'vertex'").select("graph_id", "u"))
    edges = old.join(links, "state").select("graph_id", "u", "v").union(by.filter("kind = 'edge'").select("graph_id", "u", "v"))
    return held(vertices, "nodes"), held(edges, "links")


def successors(taken: DataFrame, vertices: DataFrame, edges: DataFrame, k: int, g: int, number: int, deep: bool = False) -> DataFrame:
    """All states one step from those taken."""
    pairs = held(candidates.pairs(vertices, edges, k), "open")
    far = distances.asked(edges, pairs)
    safe = pairs.join(far, ["graph_id", "u", "v"], "left").filter(F.col("distance").isNull() | (F.col("distance") > g - 2))
    own = taken.select(F.col("state").alias("graph_id"), "session", "n", "m", "done", "girth", "a", "b", F.col("pos").alias("place"))
    full = lambda x: (F.col(f"degree_{x}") + 1 == k).cast("bigint")
    added = multisets.hashes(multisets.edge_text())
    turned: dict[str, Column] = {x: F.pmod(F.col(x) + added[x], F.lit(multisets.WRAP)) for x in multisets.SUMS}
    by_edge = safe.join(own, "graph_id").select(
        "session", F.col("graph_id").alias("parent"), F.lit("edge").alias("kind"), "u", "v", "n", (F.col("m") + 1).alias("m"), (F.col("done") + full("u") + full("v")).alias("done"),
        F.least("girth", F.col("distance") + 1).alias("girth"), *(c.alias(x) for x, c in turned.items()), F.lit(number).alias("round"), "place", (full("u") + full("v")).alias("more"),
    )
    top = vertices.groupBy("graph_id").agg(F.max("node_id").alias("top"))
    by_vertex = own.filter(F.col("n") < 2 * bounds.moore(k, g)).join(top, "graph_id", "left").select(
        "session", F.col("graph_id").alias("parent"), F.lit("vertex").alias("kind"), F.coalesce(F.col("top") + 1, F.lit(0)).cast("bigint").alias("u"), F.lit(None).cast("bigint").alias("v"), (F.col("n") + 1).alias("n"), "m", "done",
        "girth", "a", "b", F.lit(number).alias("round"), "place", F.lit(0).alias("more"),
    )
    return scored(by_edge.union(by_vertex), k, g, deep)


def run(vertices: DataFrame, edges: DataFrame, k: int, g: int, rounds: int, width: int = 1, deep: bool = False) -> Outcome:
    """Search from each graph of (graph_id, node_id), (graph_id, u, v) for k-regular graphs of girth g.

    A round expands the ``width`` best states of each session: by score, then by the round, the
    parent's place and the edit (edges before a vertex, by their ends) that made them; with width
    1 that is best-first search.  States over the upper bound are taken and not expanded.  A
    session ends when a state taken is a goal, or without states.  Graphs without vertices are not
    in the tables and have no session; an empty table gives empty ones.

    ``deep`` searches depth first: a round takes the newest states, those of one round by the score
    of their edits (ties: edges first, larger ends first), and a session goes back to older ones
    when the newest are used up; states met before are expanded again, and none is a duplicate.
    """
    bounds.check(k, g)
    with under(vertices.sparkSession, SHUFFLED):
        return searched(vertices, edges, k, g, rounds, width, deep)


def searched(vertices: DataFrame, edges: DataFrame, k: int, g: int, rounds: int, width: int, deep: bool) -> Outcome:
    """What :func:`run` returns, all of it in tables."""
    key = lambda df: df.withColumnRenamed("graph_id", "state").withColumn("state", F.concat(F.col("state"), F.lit("/start")))
    nodes, links = [held(key(vertices.select("graph_id", "node_id")), "nodes")], [held(key(edges.select("graph_id", "u", "v")), "links")]
    frontier = held(start(vertices, edges, k, g), "frontier")
    sessions, visited = held(frontier.select("session"), "sessions"), [frontier.select(PRINT).limit(0)]
    met, ended = [], []
    best = Window.partitionBy("session").orderBy(F.desc("score"), "round", "place", "kind", "u", "v")
    if deep:
        best = Window.partitionBy("session").orderBy(F.desc("round"), "place", F.desc("score"), "kind", F.desc("u"), F.desc("v"))
    first = Window.partitionBy(PRINT).orderBy("place", "kind", "u", "v")
    is_goal = validate.is_goal(F.col("done") == F.col("n"), F.col("girth"), F.lit(g)) & (F.col("n") <= bounds.upper(k, g))
    for number in range(1, rounds + 1):
        taken = frontier.withColumn("pos", F.row_number().over(best)).filter(F.col("pos") <= width)
        taken = held(taken.withColumn("state", F.concat_ws("/", "session", F.lit(str(number)), F.col("pos").cast("string"))), "taken")
        if taken.isEmpty():
            break
        goal = held(taken.filter(is_goal).groupBy("session").agg(F.min_by("state", "pos").alias("state")), "goals")
        ended.append(goal)
        going = held(taken.join(goal, "session", "left_anti").filter(F.col("n") <= bounds.upper(k, g)), "going")
        v, e = graphs(going, together(nodes), together(links))
        new = held(successors(going, v, e, k, g, number, deep), "successors")
        fresh = new
        if not deep:
            fresh = new.withColumn("copy", F.row_number().over(first)).filter("copy = 1").drop("copy").join(together(visited), PRINT, "left_anti")
            fresh = held(fresh.select(STATE), "fresh")
            visited.append(fresh.select(PRINT))
        one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
        tally = taken.select("session", one.alias("explored"), zero.alias("duplicates")).union(new.select("session", zero, one)).union(fresh.select("session", zero, -one))
        met.append(held(tally.groupBy("session").agg(F.sum("explored").alias("explored"), F.sum("duplicates").alias("duplicates")), "tally"))
        one_by_one = [*PRINT, "parent", "kind"] if deep else PRINT  # equal states of two parents are two
        rest = frontier.join(taken.select(one_by_one), one_by_one, "left_anti").join(goal, "session", "left_anti")
        frontier = held(rest.select(STATE).union(fresh), "frontier")
        nodes.append(v.withColumnRenamed("graph_id", "state"))
        links.append(e.withColumnRenamed("graph_id", "state"))
        if number % PACK == 0:
            needed = frontier.select(F.col("parent").alias("state")).distinct()
            nodes, links = ([held(together(x).join(needed, "state", "left_semi"), "packed")] for x in (nodes, links))
            visited = [held(together(visited), "visited")]
            met = [held(together(met).groupBy("session").agg(F.sum("explored").alias("explored"), F.sum("duplicates").alias("duplicates")), "tally")]
    found = sessions
    if met:
        found = found.join(together(met).groupBy("session").agg(F.sum("explored").alias("explored"), F.sum("duplicates").alias("duplicates")), "session", "left").join(together(ended), "session", "left")
    else:
        found = found.select("session", F.lit(0).cast("bigint").alias("explored"), F.lit(0).cast("bigint").alias("duplicates"), F.lit(None).cast("string").alias("state"))
    found = found.select("session", F.col("state").isNotNull().alias("success"), F.coalesce("explored", F.lit(0)).alias("explored"), F.coalesce("duplicates", F.lit(0)).alias("duplicates"), "state")
    return Outcome(held(found, "found"), frontier, together(nodes), together(links))
