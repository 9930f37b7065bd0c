"""Best-first search as tables beside a plain one."""

import pytest

from ringspark.functions import bounds
from ringspark.operators import cycles
from ringspark.operators.search import frontier

STARTS = {"three": ([0, 1, 2], []), "path": ([0, 1, 2, 3], [(0, 1), (1, 2)]), "triangle": ([4, 7, 9], [(4, 7), (4, 9), (7, 9)]), "square": ([0, 1, 2, 3], [(0, 1), (0, 3), (1, 2), (2, 3)]), "loop": ([0, 1], [(0, 0)])}


def tables(spark, starts):
    v = [(g, x) for g, (nodes, _) in starts.items() for x in nodes]
    e = [(g, *x) for g, (_, edges) in starts.items() for x in edges]
    return spark.createDataFrame(v, "graph_id string, node_id bigint"), spark.createDataFrame(e, "graph_id string, u bigint, v bigint")


def degree(edges, x):
    return sum((u == x) + (v == x) for u, v in edges)


def distance(edges, a, b):
    seen, level, d = {a}, {a}, 0
    while level:
        if b in level:
            return d
        level = {y for u, v in edges for x, y in ((u, v), (v, u)) if x in level} - seen
        seen |= level
        d += 1
    return None


def near(a, b):
    return 1 - abs(a - b) / max(a, b) if max(a, b) else 0.0


def score(state, k, g):
    nodes, edges = state
    found = cycles.shortest_cycle(cycles.of_edges(*map(list, zip(*edges, strict=True)))) if edges else None
    term = 1.0 if found == g else 0.8 if found is None or found > g else 0.0
    n, mb = len(nodes), bounds.moore(k, g)
    share = sum(degree(edges, x) == k for x in nodes) / n
    return round(0.3 * (share + near(n, mb) + term) / 3 + 0.3 * share + 0.15 * near(n, mb) + 0.15 * near(len(edges), n * k // 2) + 0.1 * term, 9), found


def plain(start, k, g, rounds, width):
    """(frontier as {(nodes, edges): score}, success, explored, duplicates)."""
    first = (tuple(start[0]), tuple(sorted(start[1])))
    open_, visited, explored, duplicates = [((-score(first, k, g)[0], 0, 0, "start", -1, -1), first)], set(), 0, 0
    for number in range(1, rounds + 1):
        open_.sort()
        taken, open_ = open_[:width], open_[width:]
        explored += len(taken)
        goals = [s for _, s in taken if len(s[0]) <= bounds.upper(k, g) and score(s, k, g)[1] == g and all(degree(s[1], x) == k for x in s[0])]
        if goals:
            return {}, True, explored, duplicates
        for place, (_, (nodes, edges)) in enumerate(taken, 1):
            new = []
            for u in nodes:
                for v in nodes:
                    if u < v and (u, v) not in edges and degree(edges, u) < k and degree(edges, v) < k:
                        d = distance(edges, u, v)
                        if d is None or d > g - 2:
                            new.append((("edge", u, v), (nodes, tuple(sorted((*edges, (u, v)))))))
            if len(nodes) < 2 * bounds.moore(k, g):
                new.append((("vertex", max(nodes) + 1, -1), ((*nodes, max(nodes) + 1), edges)))
            for edit, state in new if len(nodes) <= bounds.upper(k, g) else []:
                if state in visited:
                    duplicates += 1
                else:
                    visited.add(state)
                    open_.append(((-score(state, k, g)[0], number, place, *edit), state))
    return {s: -key[0] for key, s in open_}, False, explored, duplicates


@pytest.mark.parametrize(("rounds", "width"), [(10, 1), (3, 4)])
def test_rounds_equal_a_plain_search(spark, rounds, width):
    k, g = 2, 4
    found = frontier.run(*tables(spark, STARTS), k, g, rounds, width)
    sessions = {r.session: r for r in found.sessions.collect()}
    states = found.frontier.collect()
    assert sessions.keys() == STARTS.keys()
    for name, begin in STARTS.items():
        want, success, explored, duplicates = plain(begin, k, g, rounds, width)
        got = sessions[name]
        assert (got.success, got.explored, got.duplicates) == (success, explored, duplicates), name
        assert sorted((r.n, r.m, r.score) for r in states if r.session == name) == sorted((len(s[0]), len(s[1]), x) for s, x in want.items()), name
    assert sessions["square"].success and sessions["square"].explored <= width


def test_states_are_built_from_their_parents(spark):
    found = frontier.run(*tables(spark, {"path": STARTS["path"]}), 2, 4, rounds=4)
    nodes, links = found.nodes.collect(), found.links.collect()
    for r in found.frontier.collect():
        assert sum(x.state == r.parent for x in nodes) == r.n - (r.kind == "vertex")
        assert sum(x.state == r.parent for x in links) == r.m - (r.kind == "edge")


def test_no_sessions(spark):
    found = frontier.run(*tables(spark, {}), 3, 5, rounds=3)
    assert found.sessions.collect() == [] and found.frontier.collect() == []


def deeply(start, k, g, rounds):
    """(stack as [(nodes, edges, score)], success, explored) of a plain depth-first search."""
    mb, stack, explored = bounds.moore(k, g), [(tuple(start[0]), tuple(sorted(start[1])), None)], 0
    for _ in range(rounds):
        if not stack:
            break
        nodes, edges, _ = stack.pop()
        explored += 1
        n = len(nodes)
        if n <= bounds.upper(k, g) and score((nodes, edges), k, g)[1] == g and all(degree(edges, x) == k for x in nodes):
            return [], True, explored
        new = []
        for u in nodes if n <= bounds.upper(k, g) else ():
            for v in nodes:
                far = distance(edges, u, v)
                if u < v and (u, v) not in edges and degree(edges, u) < k and degree(edges, v) < k and (far is None or far > g - 2):
                    own = tuple(sorted((*edges, (u, v))))
                    share, found = sum(degree(own, x) == k for x in nodes) / n, score((nodes, own), k, g)[1]
                    term = 1.0 if found == g else 0.8 if found is None or found > g else 0.0
                    new.append((round((share + near(n, mb) + term) / 3 + 0.2 * (degree(own, u) == k) + 0.2 * (degree(own, v) == k), 9), 1, u, v, nodes, own))
        if n <= bounds.upper(k, g) and n < 2 * mb:
            new.append((round(1.0 if n < mb else 0.5 if n == mb else max(0.0, 0.3 - 0.1 * (n - mb)), 9), 0, max(nodes) + 1, -1, (*nodes, max(nodes) + 1), edges))
        stack += [(x[4], x[5], x[0]) for x in sorted(new, key=lambda x: x[:4])]
    return stack, False, explored


def test_depth_first_equals_a_plain_search(spark):
    k, g, rounds = 2, 4, 5
    over = bounds.upper(k, g)
    # "full" can only grow over the bound, and goes back from there
    starts = STARTS | {"two": ([3, 5], []), "full": (list(range(over)), [(i, i + 1) for i in range(over - 1)]), "over": (list(range(over + 1)), [])}
    found = frontier.run(*tables(spark, starts), k, g, rounds, deep=True)
    sessions, states = {r.session: r for r in found.sessions.collect()}, found.frontier.collect()
    for name, begin in starts.items():
        stack, success, explored = deeply(begin, k, g, rounds)
        got = sessions[name]
        assert (got.success, got.explored, got.duplicates) == (success, explored, 0), name
        assert sorted((r.n, r.m, r.score) for r in states if r.session == name) == sorted((len(n), len(m), x) for n, m, x in stack), name
    assert sessions["square"].success and sessions["over"].explored == 1


def test_no_table_of_a_search_goes_through_the_driver(spark, monkeypatch):
    seen, name = [], "spark.sql.autoBroadcastJoinThreshold"
    before, successors = spark.conf.get(name), frontier.successors
    monkeypatch.setattr(frontier, "successors", lambda *a: seen.append(spark.conf.get(name)) or successors(*a))
    found = frontier.run(*tables(spark, {"path": STARTS["path"]}), 2, 4, rounds=1, deep=True)
    assert seen == ["-1"] and spark.conf.get(name) == before
    plan = found.sessions._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # nothing is left to be joined later, under other settings
