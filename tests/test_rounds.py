"""Operators that work in rounds of tables: contraction, pointer doubling, range numbers, distances, sampling."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from ringspark.operators import candidates, contraction, cycles, distances, history, indexes, lineage, metrics, multisets, sampling, trees
from ringspark.sources import edge_lists, sinks
from ringspark.streaming import session

GRAPH = "graph_id string, u bigint, v bigint"


def subdivided(rng, own):
    """Some edges replaced by paths."""
    out, new = [], 1000
    for a, b in own:
        if a != b and rng.random() < 0.5:
            k = rng.randint(1, 6)
            path = [a, *range(new, new + k), b]
            new += k
            out += list(zip(path, path[1:], strict=False))
        else:
            out.append((a, b))
    return out


def test_contraction_equals_searches(spark):
    rng, rows, want = random.Random(0), [], {}
    for g in range(80):
        n, own = rng.randint(3, 30), set()
        for _ in range(rng.randint(2, 45)):
            a, b = rng.randrange(n), rng.randrange(n)
            if a != b or rng.random() < 0.05:
                own.add((min(a, b), max(a, b)))
        out = subdivided(rng, own)
        rows += [(f"g{g}", a, b) if rng.random() < 0.5 else (f"g{g}", b, a) for a, b in out]
        if found := cycles.shortest_cycle(cycles.of_edges(*map(list, zip(*out, strict=True)))):
            want[f"g{g}"] = found
    got = {r.graph_id: r.girth for r in contraction.girths(spark.createDataFrame(rows, GRAPH)).collect()}
    assert got == want and len(set(want.values())) > 10
    assert contraction.girths(spark.createDataFrame([], GRAPH)).count() == 0


def test_contraction_of_rings_paths_and_parallel_chains(spark):
    """What has no core: a ring and a path far longer than any number of rounds, a tree, two hubs joined by chains."""
    n = 3000
    ring = [("ring", i, (i + 1) % n) for i in range(n)] + [("path", i, i + 1) for i in range(n)] + [("tree", i, (i - 1) // 3) for i in range(1, 500)]
    theta, new = [], 10
    for length in (7, 3, 5, 9, 4):
        path = [0, *range(new, new + length - 1), 1]
        new += length
        theta += [("theta", a, b) for a, b in zip(path, path[1:], strict=False)]
    assert {r.graph_id: r.girth for r in contraction.girths(spark.createDataFrame(ring + theta, GRAPH)).collect()} == {"ring": n, "theta": 7}


def test_sums_over_a_deep_chain(spark):
    n = 20_000
    chain = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    found = trees.propagate(chain, spark.createDataFrame([(n - 1, 2.0), (100, 1.0)], "node long, reward double"))
    assert {(r.visits, r.value): r.n for r in found.groupBy("visits", "value").agg(F.count("*").alias("n")).collect()} == {(2, 3.0): 101, (1, 2.0): n - 101}


def test_sums_and_ancestors_of_random_trees(spark):
    rng = random.Random(2)
    parent = {i: rng.randrange(max(0, i - 5), i) if i % 40 else None for i in range(1, 200)} | {0: -7}
    rewards = [(rng.randrange(200), float(rng.randint(1, 5))) for _ in range(150)] + [(999, 1.0)]

    def line(x):
        while x is not None:
            yield x
            x = parent.get(x)

    tree = spark.createDataFrame(list(parent.items()), "node long, parent long")
    want = {}
    for node, value in rewards:
        for a in line(node) if node in parent else ():
            visits, total = want.get(a, (0, 0.0))
            want[a] = visits + 1, total + value
    got = trees.propagate(tree, spark.createDataFrame(rewards, "node long, reward double"))
    assert {r.node: (r.visits, r.value) for r in got.collect()} == want
    assert {(r.node, r.ancestor, r.distance) for r in trees.ancestors(tree).collect()} == {(x, a, d) for x in {*parent, -7} for d, a in enumerate(line(x))}
    some = trees.ancestors(tree, spark.createDataFrame([(150,), (0,)], "node long"))
    assert {(r.node, r.ancestor, r.distance) for r in some.collect()} == {(x, a, d) for x in (150, 0) for d, a in enumerate(line(x))}


def test_a_cycle_of_parents_is_noticed(spark):
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "node long, parent long")
    with pytest.raises(ValueError):
        trees.ancestors(loop)
    with pytest.raises(ValueError):
        trees.propagate(loop, spark.createDataFrame([(4, 1.0)], "node long, reward double"))


def test_numbers_over_many_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randint(-50, 400), rng.randint(0, 9)) for _ in range(700)]
    df = spark.createDataFrame(rows, "graph_id string, node_id long, own long").repartition(5)
    want, place, total = [], {}, {}
    for g, x, w in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        want.append((g, x, place.get(g, 0)))
        place[g] = place.get(g, 0) + 1
        total[g] = total.get(g, 0) + w
    found = indexes.numbered(df, ["graph_id"], ["node_id"], "idx", "n", ranges=9).collect()
    assert sorted(((r.graph_id, r.node_id, r.idx) for r in found), key=str) == sorted(want, key=str)
    assert all(r.n == place[r.graph_id] for r in found)
    sums = indexes.numbered(df, ["graph_id"], ["node_id", "own"], "before", weight="own", ranges=7).collect()
    for g in place:
        own = sorted((r.node_id, r.own, r.before) for r in sums if r.graph_id == g)
        assert [b for _, _, b in own] == [sum(w for _, w, _ in own[:i]) for i in range(len(own))]
    ids = [("a", x) for x in range(40) if x != 17] + [("b", -3)] + [("c", x) for x in range(9)] + [("c", 3)]
    free = indexes.smallest_free(spark.createDataFrame(ids, "graph_id string, node_id long"), ranges=6)
    assert {r.graph_id: r.free for r in free.collect()} == {"a": 17, "c": 9}


def test_distances_of_asked_pairs(spark):
    rng = random.Random(4)
    edges = {(g, *sorted(rng.sample(range(40), 2))) for g in "ab" for _ in range(45)} | {("a", 3, 3)} | {("p", i, i + 1) for i in range(30)}
    near = {}
    for g, a, b in edges:
        near.setdefault((g, a), set()).add(b)
        near.setdefault((g, b), set()).add(a)

    def far(g, a):
        seen, queue = {a: 0}, deque([a])
        while queue:
            x = queue.popleft()
            for y in near.get((g, x), ()):
                if y not in seen:
                    seen[y] = seen[x] + 1
                    queue.append(y)
        return seen

    pairs = [(g, rng.randrange(42), rng.randrange(42)) for g in "ab" for _ in range(60)] + [("p", a, b) for a in range(0, 31, 3) for b in range(0, 31, 5)] + [("none", 1, 2)]
    own = {(g, a, b): d for g, a, b in pairs if (d := far(g, a).get(b)) is not None}
    asked, graph = spark.createDataFrame(pairs, GRAPH), spark.createDataFrame(list(edges), GRAPH)
    for depth in (None, 0, 1, 3, 4):
        got = {(r.graph_id, r.u, r.v): r.distance for r in distances.asked(graph, asked, depth).collect()}
        assert got == {k: d for k, d in own.items() if depth is None or d <= depth}


def test_samples_are_draws_without_repetition(spark):
    """Where all pairs pass and fewer are there than asked for, each comes once; else the first that pass."""
    spots = spark.createDataFrame([("a", 10 * i) for i in range(7)] + [("b", 1)] + [("c", i) for i in range(200)], "graph_id string, node_id long")
    every = sampling.pairs(spots, 30, 5, lambda rows: rows).collect()
    assert sorted((r.u, r.v) for r in every if r.graph_id == "a") == [(10 * i, 10 * j) for i in range(7) for j in range(i + 1, 7)]
    assert not [r for r in every if r.graph_id == "b"] and len({(r.u, r.v) for r in every if r.graph_id == "c"}) == 30
    odd = sampling.pairs(spots, 30, 5, lambda rows: rows.filter("(u + v) % 50 = 49")).collect()
    assert len({(r.u, r.v) for r in odd if r.graph_id == "c"}) == 30 and all((r.u + r.v) % 50 == 49 for r in odd) and not [r for r in odd if r.graph_id == "a"]
    i, j = sampling.unranked(F.col("id"))
    assert all((r.i, r.j) == p for r, p in zip(spark.range(1000).select(i.alias("i"), j.alias("j")).collect(), ((i, j) for j in range(1, 46) for i in range(j)), strict=False))
    large = (1 << 31) * ((1 << 31) - 1) // 2
    assert [tuple(r) for r in spark.range(1).select(*sampling.unranked(F.lit(large - 1))).collect()] == [((1 << 31) - 2, (1 << 31) - 1)]


def test_sampled_pairs_are_safe(spark):
    rng = random.Random(6)
    edges = {("g", *sorted(rng.sample(range(30), 2))) for _ in range(28)}
    vertices, graph = spark.createDataFrame([("g", i) for i in range(30)], "graph_id string, node_id long"), spark.createDataFrame(list(edges), GRAPH)
    safe = {(r.u, r.v) for r in candidates.girth_safe(candidates.pairs(vertices, graph, 3), graph, 5).collect()}
    found = [(r.u, r.v) for r in candidates.sampled_pairs(vertices, graph, 3, 5, seed=1, most=20).collect()]
    assert len(found) == len(set(found)) == min(20, len(safe)) and set(found) <= safe


def test_columns_of_any_name_stay(spark):
    names = ["range", "top", "earlier", "own", "other", "wait", "before", "place", "_range", "_wait", "_before"]
    rows = spark.range(20).select(F.col("id").alias("at"), (F.col("id") % 5).cast("double").alias("value"), F.lit("s").alias("session"), *(F.concat(F.lit("k"), "id").alias(c) for c in names))
    for found in (history.running_best(rows, "at", "value"), history.changed(rows, "session", "value", "at"), session.debounced(rows.withColumn("at", F.timestamp_seconds("at")), "session", "at", 1)):
        kept = found.collect()
        assert len(kept) == 20 and set(rows.columns) <= set(found.columns) and all(r[c][0] == "k" and r[c] == r["range"] for r in kept for c in names)
    assert lineage.fresh(rows, "range", "x") == ("range_", "x")
    assert metrics.dense_index(spark.createDataFrame([], "graph_id string, node_id long")).count() == 0


def test_fingerprints_follow_edits(spark):
    rng = random.Random(7)
    own = {g: {tuple(sorted(rng.sample(range(12), 2))) for _ in range(14)} for g in ("a", "b")} | {"c": set()}
    vertices = spark.createDataFrame([(g, i) for g in own for i in range(12)], "graph_id string, node_id long")
    table = lambda graphs: spark.createDataFrame([(g, u, v) for g, e in graphs.items() for u, v in e], GRAPH)
    prints = multisets.of_edges(vertices, table(own))
    assert {(r.graph_id, r.a == 0 and r.b == 0) for r in prints.collect()} == {("a", False), ("b", False), ("c", True)}
    toggles = {(g, s): {tuple(sorted(rng.sample(range(12), 2))) for _ in range(s)} for g in own for s in (1, 3, 6)}
    toggles["a", 9] = own["a"]
    edits = spark.createDataFrame([(g, s, u, v) for (g, s), e in toggles.items() for u, v in e], "graph_id string, state long, u long, v long")
    found = {(r.graph_id, r.state): r.fingerprint for r in multisets.named(multisets.edited(prints, table(own), edits)).collect()}
    after = {f"{g}{s}": own[g] ^ e for (g, s), e in toggles.items()}
    spots = spark.createDataFrame([(x, 0) for x in after], "graph_id string, node_id long")
    want = {r.graph_id: r.fingerprint for r in multisets.named(multisets.of_edges(spots, table(after))).collect()}
    assert {f"{g}{s}": p for (g, s), p in found.items()} == want and found["a", 9] == "0-0"
    name = dict(enumerate(rng.sample(range(50, 99), 12)))
    moved = {g: {(name[u], name[v]) for u, v in e} for g, e in own.items()}
    same = lambda v, e: {(r.graph_id, r.a, r.b) for r in multisets.refined(v, e).collect()}
    renamed = spark.createDataFrame([(g, name[i]) for g in own for i in range(12)], "graph_id string, node_id long")
    labels = same(vertices, table(own))
    assert labels == same(renamed, table(moved)) and len({x[1:] for x in labels}) == 3


def test_edge_lists_in_parts(spark, tmp_path):
    rng = random.Random(8)
    edges = spark.createDataFrame([(g, *sorted((rng.randrange(300), rng.randrange(300)))) for g in ("a", "b") for _ in range(400)], GRAPH).distinct()
    vertices = spark.createDataFrame([(g, i) for g in ("a", "b", "c") for i in range(310)], "graph_id string, node_id long")
    text = {r.graph_id: r.text for r in edge_lists.print_lines(vertices, edges).collect()}
    manifest = sinks.write(vertices, edges, f"file://{tmp_path}/out", parts=7).collect()
    assert len({(r.graph_id, r.part) for r in manifest}) == len(manifest) > 7
    for g, whole in text.items():
        at = 0
        for r in sorted((r for r in manifest if r.graph_id == g), key=lambda r: r.part):
            (file,) = (tmp_path / "out" / f"graph_id={g}" / f"part={r.part}").glob("part-*")
            assert r.start == at and file.read_text() == (whole + "\n")[at : at + r.bytes]
            at += r.bytes
        assert at == len(whole) + 1
    back = sinks.read(spark, f"file://{tmp_path}/out")
    assert sorted(r.line for r in back.filter("graph_id = 'b'").collect()) == sorted(text["b"].split("\n"))
    with pytest.raises(Exception, match="_manifest"):
        sinks.read(spark, f"file://{tmp_path}/nothing")
