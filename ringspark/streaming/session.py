"""Sessions of a running search.

A stream of requests (session_id, kind, k, g, generator), kind being start, poll or stop, is
grouped by session; the state holds the search itself.  Each request lets the search run some
steps and gives a status row; a session that nobody polls for a while is abandoned by its timer.
"""

from __future__ import annotations

import pickle
import time
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ringspark.functions.bounds import check
from ringspark.operators.lineage import fresh
from ringspark.operators.search.methods import method
from ringspark.schema import ABANDON_AFTER, EVICT_AFTER, STATUS

STATE = "search binary, started double, last_poll double, stopped boolean"


def edge_text(graph) -> str:
    alone = [str(v) for v in sorted(graph.near) if not graph.near[v]]
    return "\n".join([*alone, *(f"{u} {v}" for u, v in graph.edges())])


def status(session_id: str, search, started: float, stopped: bool) -> dict:
    """The status record of a session."""
    graph = search.graph
    girth = graph.girth()
    return {
        "session_id": session_id, "k": search.k, "g": search.g, "step_count": search.step_count, "num_nodes": len(graph), "num_edges": graph.m,
        "girth": None if girth == float("inf") else int(girth), "is_k_regular": graph.regular(search.k), "is_complete": search.is_complete,
        "success": search.success, "stopped": stopped, "current_graph": edge_text(graph), "moore_bound": search.mb, "elapsed_time": time.time() - started,
    }


def run(requests: DataFrame, steps: int = 200, seed: int = 0, abandon_after: int = ABANDON_AFTER) -> DataFrame:
    """Status rows of a stream of requests; ``steps`` are made for each request."""

    def handle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (session_id,) = key
        if state.hasTimedOut:
            state.remove()
            return
        raw, started, stopped = None, time.time(), False
        if state.exists:
            raw, started, _, stopped = state.get
        search, rows = pickle.loads(raw) if raw else None, []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.kind == "start" and search is None:
                    check(int(r.k), int(r.g))
                    search = method(r.generator)(int(r.k), int(r.g), seed)
                elif r.kind == "stop":
                    stopped = True
                if search is None:
                    continue
                if not stopped:
                    for _ in range(steps):
                        search.step()
                rows.append(status(session_id, search, started, stopped))
        if search is None or stopped:
            if state.exists:
                state.remove()
        else:
            state.update((pickle.dumps(search), started, time.time(), stopped))
            state.setTimeoutDuration(1000 * abandon_after)
        if rows:
            yield pd.DataFrame(rows).astype({"girth": "Int32"})

    return requests.groupBy("session_id").applyInPandasWithState(handle, STATUS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def gaps(events: DataFrame, session: str, at: str, *ties: str) -> DataFrame:
    """Add ``gap``: seconds since the session's event before, null for its first; ties order
    events of one moment."""
    # timestamps without zone are read in the session's zone, which must be UTC for exact gaps
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1_000_000
    before = F.lag(seconds).over(Window.partitionBy(session).orderBy(at, *ties))
    return events.withColumn("gap", seconds - before)


def abandoned(events: DataFrame, session: str, at: str, now, limit: float = ABANDON_AFTER) -> DataFrame:
    """(session, last, idle): sessions whose last event is more than ``limit`` seconds before now."""
    last = events.groupBy(session).agg(F.max(at).alias("last"))
    idle = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 1_000_000
    return last.withColumn("idle", idle).filter(F.col("idle") > limit)


def evicted(sessions: DataFrame, now, limit: float = EVICT_AFTER) -> DataFrame:
    """Stopped sessions that nobody has asked for in a while; others stay, complete ones too."""
    return sessions.filter(F.col("stopped") & ((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 1_000_000 > limit))


def windows(events: DataFrame, session: str, at: str, gap: str) -> DataFrame:
    """(session, start, end, events): runs of events with no longer pause than the gap."""
    return events.groupBy(F.col(session), F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events")).select(session, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def stamp() -> str:
    return datetime.now(timezone.utc).isoformat()


def active(events: DataFrame, session: str, at: str, now, limit: float = ABANDON_AFTER) -> DataFrame:
    """(active): how many sessions had their last event at most ``limit`` seconds before now."""
    last = events.groupBy(session).agg(F.max(at).alias("last"))
    idle = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 1_000_000
    return last.agg(F.count_if(idle <= limit).alias("active"))


def debounced(events: DataFrame, session: str, at: str, quiet: float, *ties: str) -> DataFrame:
    """Events that the session follows by none within ``quiet`` seconds: the last of each burst."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    wait = F.lead(micros).over(Window.partitionBy(session).orderBy(at, *ties)) - micros
    (own,) = fresh(events, "wait")
    return events.withColumn(own, wait).filter(F.col(own).isNull() | (F.col(own) >= int(quiet * 1_000_000))).select(*events.columns)
