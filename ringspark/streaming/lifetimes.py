"""Sessions whose steps, ends and evictions come from timers.

Requests are (session, kind, at), kind being start, poll or stop.  Time is counted in ticks: a
stream's watermark in :func:`replayed`, the clock in :func:`worked`.  Within a tick a start comes
before polls, polls before a stop, and what is due at a tick comes before its requests.

* A running session makes a step in each tick.  It is ``complete`` after ``most`` steps, and
  ``abandoned`` at the first tick that lies more than ``idle`` ticks after its last request.
* A stop ends a session of any stage, and its state is gone.  An abandoned session can still be
  polled; the first sweep (every ``sweep`` ticks) more than ``keep`` ticks after its last request
  evicts it.  Complete sessions stay until they are stopped.
* A start while a session runs is a request like a poll that is not counted; a start of a complete
  or abandoned session evicts that and begins anew.  Polls and stops without a session do nothing.
* Requests without a session or a time take no part; kinds that are not known count as polls.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import astuple, dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ringspark.functions.bounds import check
from ringspark.operators.search.methods import RandomWalk
from ringspark.schema import ABANDON_AFTER, EVICT_AFTER, EVICT_EVERY

LIFE = "stage string, started bigint, last bigint, ended bigint, polls bigint, steps bigint"
SAID = "event string, started bigint, happened bigint, polls bigint, steps bigint"
MADE = "step bigint, event string, u bigint, v bigint"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Rules:
    """Limits in ticks."""

    idle: int = ABANDON_AFTER
    keep: int = EVICT_AFTER
    sweep: int = EVICT_EVERY
    most: int = 10_000


@dataclass
class Life:
    """One session's figures; times are ticks.  ``advance`` and ``request`` yield (event, tick)."""

    stage: str = "none"
    started: int = 0
    last: int = 0
    ended: int = 0
    polls: int = 0
    steps: int = 0

    def due(self, rules: Rules) -> tuple[int, str] | None:
        """The next thing that happens without a request."""
        if self.stage == "running":
            return min((self.last + rules.idle + 1, "abandoned"), (self.started + rules.most, "complete"), key=lambda then: then[0])
        if self.stage == "abandoned":
            return -(-max(self.last + rules.keep + 1, self.ended) // rules.sweep) * rules.sweep, "evicted"
        return None

    def advance(self, tick: int, rules: Rules) -> Iterator[tuple[str, int]]:
        """All that is due up to a tick."""
        while (then := self.due(rules)) and then[0] <= tick:
            at, event = then
            if event == "evicted":
                yield event, at
                self.stage = "none"
            else:
                self.stage, self.steps, self.ended = event, at - self.started, at
                yield event, at
        if self.stage == "running":
            self.steps = tick - self.started

    def request(self, tick: int, start: bool, polls: int, stop: bool) -> Iterator[tuple[str, int]]:
        """The requests of a tick, after what is due at it."""
        if start:
            if self.stage in ("complete", "abandoned"):
                yield "evicted", tick
                self.stage = "none"
            if self.stage == "none":
                self.stage, self.started, self.ended, self.polls, self.steps = "running", tick, tick, 0, 0
            self.last = tick
        if self.stage == "none":
            return
        if polls:
            self.last, self.polls = tick, self.polls + polls
        if stop:
            yield "stopped", tick
            self.stage = "none"


class Replay(StatefulProcessor):
    """Sessions over event time: rows are one for each session and tick, complete up to the watermark."""

    def __init__(self, rules: Rules, tick_ms: int):
        self.rules, self.tick_ms = rules, tick_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.life = handle, handle.getValueState("life", LIFE)

    def handleInputRows(self, key, rows, timerValues):
        life, said = self.read(), []
        timer = life.due(self.rules)
        for _, tick, start, polls, stop in sorted(rows, key=lambda r: r[1]):  # one row a tick: as many as the stream has moved by
            self.note(key, life, life.advance(tick, self.rules), said)
            self.note(key, life, life.request(tick, start, polls, stop), said)
        self.write(life, timer)
        yield from said

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        life, said = self.read(), []
        timer = life.due(self.rules)
        self.note(key, life, life.advance(timerValues.getCurrentWatermarkInMs() // self.tick_ms, self.rules), said)
        self.write(life, timer)
        yield from said

    def note(self, key, life: Life, events, said: list) -> None:
        for event, at in events:
            said.append(Row(session=key[0], event=event, started=life.started * self.tick_ms, happened=at * self.tick_ms, polls=life.polls, steps=life.steps))

    def read(self) -> Life:
        own = self.life.get()
        return Life(*own) if own else Life()

    def write(self, life: Life, timer: tuple[int, str] | None) -> None:
        """Keep the session; ``timer`` is what was due before, and its tick the only timer there is."""
        then = life.due(self.rules)
        if timer and (not then or then[0] != timer[0]):
            self.handle.deleteTimer(timer[0] * self.tick_ms)
        if then and (not timer or then[0] != timer[0]):
            self.handle.registerTimer(then[0] * self.tick_ms)
        if life.stage == "none":
            self.life.clear()
        else:
            self.life.update(astuple(life))


def replayed(requests: DataFrame, rules: Rules, tick: int = 1, delay: str = "0 seconds") -> DataFrame:
    """(session, event, started, happened, polls, steps): what becomes of the sessions of a stream of requests.

    Ticks have ``tick`` seconds; requests may come ``delay`` behind the latest.  The requests of a
    session within a tick are counted together, partly before they are shuffled, so that a busy
    session reaches its state as one row for each tick.
    """
    kinds = requests.filter(F.col("session").isNotNull() & F.col("at").isNotNull()).withWatermark("at", delay)
    start, stop = F.col("kind") == "start", F.col("kind") == "stop"
    ticks = kinds.groupBy("session", F.window("at", f"{tick} seconds").alias("w")).agg(
        F.coalesce(F.bool_or(start), F.lit(False)).alias("start"),
        F.count_if(F.coalesce(~start & ~stop, F.lit(True))).alias("polls"),
        F.coalesce(F.bool_or(stop), F.lit(False)).alias("stop"),
    )
    # rows and not pandas: a session has few in a batch, and a frame of each costs far more than they do
    rows = ticks.select("session", (F.unix_millis("w.start") / (1000 * tick)).cast("bigint").alias("tick"), "start", "polls", "stop")
    out = StructType([requests.schema["session"], *StructType.fromDDL(SAID).fields])
    found = rows.groupBy("session").transformWithState(Replay(rules, 1000 * tick), out, "append", "EventTime")
    return found.withColumns({c: F.timestamp_millis(c) for c in ("started", "happened")})


class Worker(StatefulProcessor):
    """Random walks over the clock: a timer makes the steps, the graph is kept edge by edge.

    A step draws from the session, the seed and its own number, so that a lost executor's steps are
    made again just as they were.
    """

    def __init__(self, rules: Rules, tick_ms: int, steps: int, seed: int, keep_ms: int):
        self.rules, self.tick_ms, self.steps, self.seed, self.keep_ms = rules, tick_ms, steps, seed, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # what nobody touches goes by itself in the end, complete sessions too
        self.handle = handle
        self.life = handle.getValueState("life", f"{LIFE}, k int, g int, made bigint", self.keep_ms)
        self.vertices = handle.getMapState("vertices", "v bigint", "is_there boolean", self.keep_ms)
        self.edges = handle.getMapState("edges", "u bigint, v bigint", "is_there boolean", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):
        said, now = [], timerValues.getCurrentProcessingTimeInMs() // self.tick_ms
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                life, k, g, made = self.read()
                said += [(key[0], made, event, None, None) for event, _ in life.advance(now, self.rules)]
                fresh = r.kind == "start" and life.stage != "running"
                if fresh:
                    check(int(r.k), int(r.g))
                said += [(key[0], made, event, None, None) for event, _ in life.request(now, r.kind == "start", int(r.kind not in ("start", "stop")), r.kind == "stop")]
                if fresh:
                    k, g, made = int(r.k), int(r.g), 0
                    self.vertices.clear()
                    self.edges.clear()
                    for v in RandomWalk(k, g).graph.near:
                        self.vertices.updateValue((v,), (True,))
                self.write(life, k, g, made)
        self.wake(timerValues)
        if said:
            yield self.frame(said)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.life.exists():
            return
        life, k, g, made = self.read()
        said = [(key[0], made, event, None, None) for event, _ in life.advance(timerValues.getCurrentProcessingTimeInMs() // self.tick_ms, self.rules)]
        if life.stage == "running":
            search = self.search(k, g)
            for _ in range(self.steps):
                before, vertices = set(search.graph.edges()), set(search.graph.near)
                search.rng = random.Random(f"{self.seed}:{key[0]}:{made}")
                search.step()
                made += 1
                said += self.changed(key[0], made, before, vertices, search.graph)
                if search.is_complete or made >= self.rules.most:
                    life.stage = "complete"
                    said.append((key[0], made, "success" if search.success else "complete", None, None))
                    break
        self.write(life, k, g, made)
        self.wake(timerValues)
        if said:
            yield self.frame(said)

    def search(self, k: int, g: int) -> RandomWalk:
        out = RandomWalk(k, g)
        out.graph.near = {v: set() for (v,) in self.vertices.keys()}
        out.graph.m = 0
        for u, v in self.edges.keys():
            out.graph.add(u, v)
        return out

    def changed(self, session, step: int, before: set, vertices: set, graph) -> list[tuple]:
        """Write what a step changed, and say it."""
        after, own, said = set(graph.edges()), set(graph.near), []
        for v in own - vertices:
            self.vertices.updateValue((v,), (True,))
            said.append((session, step, "vertex_added", v, None))
        for e in after - before:
            self.edges.updateValue(e, (True,))
            said.append((session, step, "edge_added", *e))
        for e in before - after:
            self.edges.removeKey(e)
            said.append((session, step, "edge_removed", *e))
        for v in vertices - own:
            self.vertices.removeKey((v,))
            said.append((session, step, "vertex_removed", v, None))
        return said

    def frame(self, said: list) -> pd.DataFrame:
        return pd.DataFrame(said, columns=["session", "step", "event", "u", "v"]).astype({"u": "Int64", "v": "Int64"})

    def read(self) -> tuple[Life, int, int, int]:
        if not self.life.exists():
            return Life(), 0, 0, 0
        own = tuple(self.life.get())
        return Life(*own[: len(fields(Life))]), *own[len(fields(Life)) :]

    def write(self, life: Life, k: int, g: int, made: int) -> None:
        if life.stage == "none":
            for state in (self.life, self.vertices, self.edges):
                state.clear()
        else:
            self.life.update((*astuple(life), k, g, made))

    def wake(self, timerValues) -> None:
        """One timer: the next tick while it runs, the sweep once it is abandoned."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        life = self.read()[0]
        if then := life.due(self.rules):
            tick = timerValues.getCurrentProcessingTimeInMs() // self.tick_ms + 1
            self.handle.registerTimer((tick if life.stage == "running" else then[0]) * self.tick_ms)


def worked(requests: DataFrame, rules: Rules = Rules(), tick: int = 1, steps: int = 1000, seed: int = 0, keep: int = 86_400) -> DataFrame:
    """(session, step, event, u, v): edits and ends of random walks that run while they are polled.

    ``requests`` have session, kind, k and g.  Each tick of ``tick`` seconds makes ``steps`` steps; a
    session that nothing touches for ``keep`` seconds goes, whatever its stage.  A walk takes its
    next step from its graph alone, so the state is the graph and a few figures.
    """
    out = StructType([requests.schema["session"], *StructType.fromDDL(MADE).fields])
    return requests.filter(F.col("session").isNotNull()).groupBy("session").transformWithStateInPandas(Worker(rules, 1000 * tick, steps, seed, 1000 * keep), out, "append", "ProcessingTime")


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """The settings that a query with timers must be started under."""
    own = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "true"}
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def drained(stream: DataFrame, path: str) -> DataFrame:
    """A stream over all that its source holds, written below ``path`` and read back as a table."""
    spark = stream.sparkSession
    with stateful(spark):
        query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    if not rows.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(rows):  # a source without files makes no batch
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
