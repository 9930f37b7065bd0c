"""Sessions by timers: over event time against one plain pass, over the clock against the walk itself."""

import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ringspark.operators.search.methods import RandomWalk
from ringspark.streaming import lifetimes
from ringspark.streaming.lifetimes import Life, Rules

RULES = Rules(idle=5, keep=9, sweep=4, most=20)
ZERO = datetime(2024, 1, 1)


def plainly(requests, until: int, rules=RULES):
    """What is said of the sessions, tick by tick, from (session, kind, tick) of one list."""
    out = []
    for name in {s for s, _, _ in requests}:
        life, last = None, 0
        own = [(t, k) for s, k, t in requests if s == name]
        for tick in range(until + 1):
            now = [k for t, k in own if t == tick] if tick < until else []
            if life and life["stage"] == "running":
                life["steps"] = tick - life["started"]
                if tick - last > rules.idle:
                    life["stage"] = "abandoned"
                    out.append((name, "abandoned", life["started"], tick, life["polls"], life["steps"]))
                elif life["steps"] == rules.most:
                    life["stage"] = "complete"
                    out.append((name, "complete", life["started"], tick, life["polls"], life["steps"]))
            if life and life["stage"] == "abandoned" and tick % rules.sweep == 0 and tick - last > rules.keep:
                out.append((name, "evicted", life["started"], tick, life["polls"], life["steps"]))
                life = None
            if "start" in now:
                if life and life["stage"] != "running":
                    out.append((name, "evicted", life["started"], tick, life["polls"], life["steps"]))
                    life = None
                life, last = life or {"stage": "running", "started": tick, "polls": 0, "steps": 0}, tick
            polls = sum(k not in ("start", "stop") for k in now)
            if life and polls:
                life["polls"], last = life["polls"] + polls, tick
            if life and "stop" in now:
                out.append((name, "stopped", life["started"], tick, life["polls"], life["steps"]))
                life = None
    return Counter(out)


def drawn(seed: int, sessions: int, until: int):
    """Requests with bursts, long pauses and ties."""
    rng, out = random.Random(seed), []
    for s in range(sessions):
        tick = 0
        while tick < until:
            tick += rng.choice([0, 0, 1, 1, 2, 4, 5, 6, 9, 16])
            out.append((f"s{s}", rng.choice(["start", "poll", "poll", "poll", "poll", "look", "stop"] if rng.random() < 0.5 else ["start", "poll", "poll"]), tick))
    return [r for r in out if r[2] < until]


def ticks(df):
    return Counter((r.session, r.event, int((r.started - ZERO).total_seconds()), int((r.happened - ZERO).total_seconds()), r.polls, r.steps) for r in df.collect())


def test_life_over_ticks():
    for seed in range(30):
        requests, said = drawn(seed, 3, 150), Counter()
        for name in {r[0] for r in requests}:
            life = Life()
            own = sorted({t for s, _, t in requests if s == name})
            for tick in [*own, 150]:
                kinds = [k for s, k, t in requests if (s, t) == (name, tick)]
                for events in (life.advance(tick, RULES), life.request(tick, "start" in kinds, sum(k in ("poll", "look") for k in kinds), "stop" in kinds)):
                    said.update((name, event, life.started, at, life.polls, life.steps) for event, at in events)
        assert said == plainly(requests, 150), seed


@pytest.mark.parametrize("files", [1, 4])
def test_replay_in_one_batch_and_in_many(spark, tmp_path, files):
    requests = drawn(99, 12, 120) + [("hot", "poll", t) for t in range(3, 120) for _ in range(20)] + [("hot", "start", 2)]
    requests = [r for r in requests if r[2] < 120] + [("end", "poll", 120)]  # the last request moves the watermark
    rows = [(s, k, ZERO + timedelta(seconds=t), "x") for s, k, t in sorted(requests, key=lambda r: r[2])]
    rows += [(None, "start", ZERO, "x"), ("s0", "poll", None, None)]  # no part
    schema = "session string, kind string, at timestamp, tick string"  # a column with a name of its own
    for i in range(files):
        own = [r for r in rows if r[2] is None and i == 0 or r[2] and i * 121 // files <= (r[2] - ZERO).total_seconds() < (i + 1) * 121 // files + (i == files - 1)]
        random.Random(i).shuffle(own)
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)  # files are read in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = lifetimes.drained(lifetimes.replayed(stream, RULES), str(tmp_path / "out"))
    want = plainly([r for r in requests if r[0] != "end"], 120)
    assert ticks(got) == want and {e for _, e, *_ in want} == {"abandoned", "complete", "evicted", "stopped"}


def test_replay_of_nothing(spark, tmp_path):
    schema = "session bigint, kind string, at timestamp"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "rows"))
    (tmp_path / "none").mkdir()
    for name in ("rows", "none"):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / name))
        got = lifetimes.drained(lifetimes.replayed(stream, RULES), str(tmp_path / f"{name}-out"))
        assert got.count() == 0 and got.schema["session"].dataType.typeName() == "long"


def test_kinds_that_are_null_count_as_polls(spark, tmp_path):
    rows = [("a", "start", 0), ("a", None, 4), ("a", None, 4), ("b", None, 5), ("a", "stop", 7), ("b", "poll", 9)]
    spark.createDataFrame([(s, k, ZERO + timedelta(seconds=t)) for s, k, t in rows], "session string, kind string, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, kind string, at timestamp").parquet(str(tmp_path / "in"))
    assert ticks(lifetimes.drained(lifetimes.replayed(stream, RULES), str(tmp_path / "out"))) == Counter([("a", "stopped", 0, 7, 2, 7)])


def walked(session: str, k: int, g: int, most: int, seed: int = 0):
    """The same walk in one process."""
    search = RandomWalk(k, g)
    for made in range(most):
        search.rng = random.Random(f"{seed}:{session}:{made}")
        search.step()
        if search.is_complete:
            return search, made + 1
    return search, most


def test_walks_by_the_clock(spark, tmp_path):
    """Timers make the steps; the edits lead to the graph of the same walk; idle sessions are evicted."""
    schema = "session string, kind string, k int, g int"
    spark.createDataFrame([("short", "start", 3, 5), ("gone", "start", 4, 6), ("cut", "start", 3, 6), ("cut", "stop", None, None)], schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    rules = Rules(idle=80, keep=5, sweep=2, most=60)  # a batch may take longer than a few ticks
    with lifetimes.stateful(spark):
        query = lifetimes.worked(stream, rules, tick=1, steps=20).writeStream.format("memory").queryName("walks").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        began, kinds = time.time(), {}
        while time.time() - began < 90 and not {"complete", "success"} & kinds.get("short", set()):
            time.sleep(0.5)
            kinds = {r.session: set(r.events) for r in spark.table("walks").groupBy("session").agg(F.collect_set("event").alias("events")).collect()}
        rows = spark.table("walks").collect()
    finally:
        query.stop()
    assert "stopped" in kinds["cut"], kinds
    made = {r.session: r.step for r in rows if r.event in ("complete", "success")}
    want, steps = walked("short", 3, 5, rules.most)
    assert made["short"] == steps
    edges, vertices = set(), set(RandomWalk(3, 5).graph.near)
    for r in sorted((r for r in rows if r.session == "short"), key=lambda r: (r.step, {"vertex_added": 0, "vertex_removed": 3}.get(r.event, 1))):
        if r.event == "edge_added":
            edges.add((r.u, r.v))
        elif r.event == "edge_removed":
            edges.remove((r.u, r.v))
        elif r.event == "vertex_added":
            vertices.add(r.u)
        elif r.event == "vertex_removed":
            vertices.remove(r.u)
    assert sorted(edges) == want.graph.edges() and vertices == set(want.graph.near)


def test_walks_that_nobody_polls_are_evicted(spark, tmp_path):
    schema = "session string, kind string, k int, g int"
    spark.createDataFrame([("gone", "start", 4, 6)], schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    with lifetimes.stateful(spark):
        query = lifetimes.worked(stream, Rules(idle=2, keep=3, sweep=2, most=10**6), tick=1, steps=2).writeStream.format("memory").queryName("gone").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        began, events = time.time(), []
        while time.time() - began < 90 and "evicted" not in events:
            time.sleep(0.5)
            events = [r.event for r in spark.table("gone").collect()]
    finally:
        query.stop()
    assert [e for e in events if e in ("abandoned", "evicted")] == ["abandoned", "evicted"]


def test_a_batch_asks_the_state_as_often_for_one_tick_as_for_many():
    calls = []

    class State:
        own = None

        def get(self):
            calls.append("get")
            return self.own

        def update(self, own):
            calls.append("update")
            self.own = own

        def registerTimer(self, at):
            calls.append(("set", at))

        def deleteTimer(self, at):
            calls.append(("unset", at))

    replay = lifetimes.Replay(lifetimes.Rules(idle=5, keep=9, sweep=4, most=50), 1000)
    replay.handle = replay.life = State()
    batch = lambda *ticks: list(replay.handleInputRows(("a",), iter([("a", t, t == 1, int(t > 1), False) for t in ticks]), None))
    assert batch(3, 1, 2) == [] and calls == ["get", ("set", 9000), "update"]
    calls.clear()
    assert batch(4) == [] and calls == ["get", ("unset", 9000), ("set", 10000), "update"]
    calls.clear()
    assert [tuple(r) for r in batch(11)] == [("a", "abandoned", 1000, 10000, 3, 9)]
    assert calls == ["get", ("unset", 10000), ("set", 24000), "update"]
