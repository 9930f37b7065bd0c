"""Hard negatives by an exact inner-product join over Voronoi cells.

Components become whole numbers, floor(scale * x), and a score is the inner product of two rows.
Rows are augmented by sqrt(M^2 - |y|^2) for the greatest norm M and anchors by 0, so that a larger
inner product is a smaller distance and the triangle inequality holds between rows, anchors and
pivots.  Pivots come from a bounded sample.  Each anchor belongs to the group of its nearest pivot;
a group is known by the least and greatest distance of its anchors from every pivot, and by how
near or far a row may be that one of them still needs.  A row goes to the groups whose bounds do
not rule it out, and there all its scores are computed: nothing is approximate.

Two joins are done.  The first finds each anchor's best rows of its own label (its positives).
What an anchor needs is bounded by the scores of the sample.  The second finds, for every
positive, the best rows of other labels with a score of at most ``high`` and at least ``low``
hundredths of the positive's: rows between two distances.

Anchors of a group are dealt into blocks of at most about ANCHORS, rows into chunks by a hash, so
a hot vector or group is spread over many tasks.  A task holds one block of anchors and their best
rows so far; the rows stream past them, ordered by Spark.  The best of all chunks are found by a
window over (anchor, positive), of which each task passes on only the first few.

Defined results: rows with a null id, label, vector or component, with a component that is not
finite or of over 2^24 after scaling take no part; a shorter vector counts as filled up with
zeros; rows with the same id count once, with the least label and then the least vector; equal
scores are ordered by id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard

SCALE, LARGEST = 256, 1 << 24
PIVOTS, SAMPLE, SAMPLE_NUMBERS = 16, 4096, 400_000
ANCHORS = 4096
STREAM = 4096
CELLS = 2_000_000
NONE = np.iinfo(np.int64).min


def whole_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, vec, norm): the scaled components as 32-bit numbers, the squared norm."""
    for batch in batches:
        lists = batch.column(2)
        at, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
        with np.errstate(invalid="ignore", over="ignore"):
            scaled = np.floor(SCALE * values)
            bad = np.r_[0, np.cumsum(~(np.abs(scaled) <= LARGEST))]
        good = bad[at[1:]] == bad[at[:-1]]
        whole = np.where(np.abs(scaled) <= LARGEST, scaled, 0).astype("<i4")
        squares = np.r_[0, np.cumsum(whole.astype(np.int64) ** 2)]
        raw = whole.tobytes()
        vectors = [raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.binary()), pa.array(squares[at[1:]] - squares[at[:-1]], pa.int64())], ["vec_id", "label", "vec", "norm"])
        yield out.filter(pa.array(good))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros."""
    own = vectors.to_pylist()
    if any(len(v) != 4 * width for v in own):
        own = [v.ljust(4 * width, b"\0") for v in own]
    return np.frombuffer(b"".join(own), dtype="<i4").reshape(len(own), width)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b, as 64-bit whole numbers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Space:
    """The pivots among augmented rows, and a sample of rows that bounds what anchors need."""

    def __init__(self, ids: list[int], labels: list[int], vectors: list[bytes], width: int, largest: int):
        self.width, self.largest = width, float(largest)
        self.ids, self.labels = np.array(ids, dtype=np.int64), np.array(labels, dtype=np.int64)
        self.sample = matrix(pa.array(vectors, pa.binary()), width)
        distinct = np.unique(self.sample, axis=0)
        # the first pivot is the row with the least components, each next one is farthest from those before
        augmented = self.augmented(distinct)
        chosen = [0]
        gap = np.full(len(distinct), np.inf)
        while len(chosen) < min(PIVOTS, len(distinct)):
            gap = np.minimum(gap, self.largest - augmented @ augmented[chosen[-1]])
            gap[chosen] = -1
            chosen.append(int(gap.argmax()))
        self.pivots = augmented[chosen]
        self.slack = 1e-5 * self.largest**0.5 + 1e-3

    def augmented(self, rows: np.ndarray) -> np.ndarray:
        rows = rows.astype(np.float64)
        return np.c_[rows, np.sqrt(np.maximum(0, self.largest - (rows * rows).sum(axis=1)))]

    def of_rows(self, rows: np.ndarray) -> np.ndarray:
        """Distances of rows from the pivots."""
        return np.sqrt(np.maximum(0, 2 * self.largest - 2 * self.augmented(rows) @ self.pivots.T))

    def of_anchors(self, anchors: np.ndarray) -> np.ndarray:
        a = anchors.astype(np.float64)
        return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + self.largest - 2 * a @ self.pivots[:, :-1].T))

    def radius(self, anchors: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which a row has the given score."""
        norm = (anchors.astype(np.float64) ** 2).sum(axis=1)
        return np.sqrt(np.maximum(0, norm + self.largest - 2 * score))


def best(row: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest values over NONE, first places first among equal ones.

    Values at the border of the k-th place are settled by place, so a value that comes very
    often costs no sorting.
    """
    found = np.flatnonzero(row > NONE)
    if len(found) > k:
        own = row[found]
        border = np.partition(own, len(own) - k)[len(own) - k]
        over = found[own > border]
        found = np.sort(np.r_[over, found[own == border][: k - len(over)]])
    return found[np.argsort(-row[found], kind="stable")]


def of_same_label(score: np.ndarray, labels: np.ndarray, ids: np.ndarray, anchors: dict) -> list[np.ndarray]:
    """Scores of other rows of the anchor's label, else NONE."""
    own = (anchors["label"][:, None] == labels[None]) & (anchors["vec_id"][:, None] != ids[None])
    return [np.where(own, score, NONE)]


def of_other_labels(low: int, high: int) -> Callable:
    def eligible(score: np.ndarray, labels: np.ndarray, ids: np.ndarray, anchors: dict) -> list[np.ndarray]:
        """For each positive of the anchor, the scores of rows of other labels in its range, else NONE."""
        other, hundred = anchors["label"][:, None] != labels[None], 100 * score
        return [np.where(other & (hundred <= high * p[:, None]) & (hundred >= low * p[:, None]) & (p[:, None] > NONE), score, NONE) for p in anchors["wanted"].T]

    return eligible


def local_join(width: int, k: int, eligible: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come by unit and chunk, anchors (with what they want) before the rows.

    Gives (anchor_id, place, other_id, score): for each anchor and each of its wants the k best.
    """
    names = ["anchor_id", "place", "other_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, anchors, tops = None, [], None, {}

        def gathered() -> dict:
            """The anchors that came, as arrays; wants in columns, filled up with NONE."""
            wants = [w for part in held for w in part[3]]
            most = max(1, max(map(len, wants)))
            return {
                "vec_id": np.concatenate([p[0] for p in held]), "label": np.concatenate([p[1] for p in held]), "vec": np.concatenate([p[2] for p in held]),
                "wanted": np.array([w + [NONE] * (most - len(w)) for w in wants], dtype=np.int64),
            }

        def meet(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
            order = np.argsort(ids, kind="stable")
            ids, labels, rows = ids[order], labels[order], rows[order]
            step = max(1, CELLS // len(ids))
            for at in range(0, len(anchors["vec_id"]), step):
                some = {c: x[at : at + step] for c, x in anchors.items()}
                for place, own in enumerate(eligible(scores(some["vec"], rows), labels, ids, some)):
                    for n in np.flatnonzero(own.max(axis=1) > NONE).tolist():
                        found = best(own[n], k)
                        value, other = own[n][found], ids[found]
                        if (before := tops.get((at + n, place))) is not None:
                            value, other = np.r_[before[0], value], np.r_[before[1], other]
                            first = np.lexsort((other, -value))[:k]
                            value, other = value[first], other[first]
                        tops[at + n, place] = value, other

        def close() -> Iterator[pa.RecordBatch]:
            if tops:
                rows = [(anchors["vec_id"][n], place, o, v) for (n, place), (value, other) in tops.items() for v, o in zip(value, other, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names)

        for batch in batches:
            unit, chunk, kind = (batch.column(c).to_numpy() for c in range(3))
            cuts = np.flatnonzero((unit[1:] != unit[:-1]) | (chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(unit)], strict=True):
                if not b:
                    continue
                if (unit[a], chunk[a]) != key:
                    yield from close()
                    key, held, anchors, tops = (unit[a], chunk[a]), [], None, {}
                for at in range(a, b, STREAM):
                    part = batch.slice(at, min(STREAM, b - at))
                    ids, labels, rows = part.column(3).to_numpy(), part.column(4).to_numpy(), matrix(part.column(5), width)
                    if kind[a] == 0:
                        held.append((ids, labels, rows, [w or [] for w in part.column(6).to_pylist()]))
                    elif held:
                        anchors = anchors or gathered()
                        meet(ids, labels, rows)
        yield from close()

    return run


def needs(space: Space, k: int, eligible: Callable, low: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(vec_id, home, inner, outer, away): the anchor's nearest pivot, between which distances the
    rows lie that it needs, and how far it is from each pivot.

    The k-th best eligible row of the sample is a lower bound for the k-th best of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                vec, wants = matrix(part.column(2), space.width), [w or [] for w in part.column(3).to_pylist()]
                most = max(1, max(map(len, wants)))
                anchors = {"vec_id": part.column(0).to_numpy(), "label": part.column(1).to_numpy(), "wanted": np.array([w + [NONE] * (most - len(w)) for w in wants], dtype=np.int64)}
                own = eligible(scores(vec, space.sample), space.labels, space.ids, anchors)
                fall = np.full(len(vec), np.inf)
                for place, found in enumerate(own):
                    p = anchors["wanted"][:, place]
                    there = np.sort(found, axis=1)[:, -k] if found.shape[1] >= k else np.full(len(vec), NONE)
                    least = np.full(len(vec), -np.inf) if low is None else low * p / 100 - 1
                    floor = np.where(there > NONE, there.astype(np.float64), least)
                    fall = np.minimum(fall, floor if low is None else np.where(p >= 0, floor, np.inf))
                away = space.of_anchors(vec)
                outer = np.where(np.isinf(fall), np.where(fall < 0, np.inf, -np.inf), space.radius(vec, np.where(np.isinf(fall), 0, fall)))
                inner = np.zeros(len(vec)) if low is None else space.radius(vec, np.maximum(0, anchors["wanted"].max(axis=1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(away.argmin(axis=1), pa.int64()), pa.array(inner), pa.array(outer), pa.array(list(away), pa.list_(pa.float64()))], ["vec_id", "home", "inner", "outer", "away"]
                )

    return run


def joined(rows: DataFrame, anchors: DataFrame, space: Space, k: int, eligible: Callable, low: int | None = None) -> DataFrame:
    """(anchor_id, place, other_id, score, rank): the k best eligible rows; anchors have ``wanted``."""
    spark = rows.sparkSession
    found = anchors.select("vec_id", "label", "vec", "wanted").mapInArrow(needs(space, k, eligible, low), "vec_id long, home long, inner double, outer double, away array<double>")
    placed = cut(found, "anchor-needs")
    groups = {r["home"]: r for r in placed.groupBy("home").agg(F.count("*").alias("n"), F.min("inner").alias("inner"), F.max("outer").alias("outer")).collect()}
    ranges = placed.select("home", F.posexplode("away").alias("m", "d")).groupBy("home", "m").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).collect()
    n_pivots = len(space.pivots)
    lo, hi = np.zeros((n_pivots, n_pivots)), np.zeros((n_pivots, n_pivots))
    for r in ranges:
        lo[r["home"], r["m"]], hi[r["home"], r["m"]] = r["lo"], r["hi"]
    # units: blocks of the anchors of a group, numbered over all groups
    blocks = {g: -(-r["n"] // ANCHORS) for g, r in sorted(groups.items()) if r["outer"] >= 0}
    starts, units = {}, 0
    for g, n in blocks.items():
        starts[g], units = units, units + n
    n_chunks = max(1, -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, units)))

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row once for each unit that might need it."""
        for batch in batches:
            for at in range(0, batch.num_rows, STREAM):
                part = batch.slice(at, STREAM)
                d = space.of_rows(matrix(part.column(2), space.width))
                for g, start in starts.items():
                    nearest = np.maximum(lo[g] - d, d - hi[g]).max(axis=1)
                    farthest = (hi[g] + d).min(axis=1)
                    some = part.filter(pa.array((nearest <= groups[g]["outer"] + space.slack) & (farthest >= groups[g]["inner"] - space.slack)))
                    for unit in range(start, start + blocks[g] if some.num_rows else start):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(some.num_rows, unit, dtype=np.int64)), *some.columns], ["unit", "vec_id", "label", "vec"])

    no_wants = F.lit(None).cast("array<bigint>").alias("wanted")
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(n_chunks)).alias("chunk")
    sent = rows.select("vec_id", "label", "vec").mapInArrow(serve, "unit long, vec_id long, label long, vec binary").select("unit", chunk, F.lit(1).alias("kind"), "vec_id", "label", "vec", no_wants)
    homes = placed.filter(F.col("home").isin(list(starts))).select("vec_id", "home")
    number = lambda of: F.element_at(F.create_map(*(F.lit(x) for pair in of.items() for x in pair)), F.col("home")) if of else F.lit(0)
    unit = (number(starts) + F.pmod(F.xxhash64("vec_id", F.lit("block")), number(blocks))).cast("long").alias("unit")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_chunks - 1).cast("long"))).alias("chunk")
    asked = anchors.join(homes, "vec_id").select(unit, every, F.lit(0).alias("kind"), "vec_id", "label", "vec", "wanted")
    dealt = asked.union(sent).repartition(max(1, min(units * n_chunks, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))), "unit", "chunk").sortWithinPartitions("unit", "chunk", "kind")
    tops = dealt.mapInArrow(local_join(space.width, k, eligible), "anchor_id long, place int, other_id long, score long")
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "other_id")
    return tops.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def prepared(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(vec_id, label, vec, norm) of the rows that take part, each id once."""
    named = rows.select(rows[id_col].cast("long").alias("vec_id"), label.cast("long").alias("label"), rows[vector_col].cast("array<double>").alias("v")).filter("vec_id is not null and label is not null and v is not null")
    out = cut(named.mapInArrow(whole_numbers, "vec_id long, label long, vec binary, norm long"), "vectors")
    again = cut(out.groupBy("vec_id").count().filter("count > 1").select("vec_id"), "repeated-ids")
    if again.isEmpty():
        discard(again)
        return out
    once = out.join(again, "vec_id").groupBy("vec_id").agg(F.min(F.struct("label", "vec", "norm")).alias("x")).select("vec_id", "x.*")
    return cut(out.join(again, "vec_id", "left_anti").union(once), "vectors-once")


def mine(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` says by ``vec_id`` which rows are anchors; ``label`` stands for the column of that
    name.  Low and high are hundredths of a positive's score.
    """
    own = prepared(rows, id_col, vector_col, F.col("label") if label is None else label)
    figures = own.agg(F.max("norm").alias("norm"), F.max(F.length("vec")).alias("bytes")).first()
    width = (figures["bytes"] or 0) // 4
    drawn = own.orderBy(F.xxhash64("vec_id", F.lit("pivot")), "vec_id").limit(max(64, min(SAMPLE, SAMPLE_NUMBERS // max(1, width)))).select("vec_id", "label", "vec").collect()
    if not drawn:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    space = Space(*(list(c) for c in zip(*drawn, strict=True)), width, figures["norm"])
    anchors = own.filter(anchor).select("vec_id", "label", "vec")
    first = joined(own, anchors.withColumn("wanted", F.lit(None).cast("array<bigint>")), space, positives, of_same_label)
    found = cut(first.select("anchor_id", (F.col("rank") - 1).alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    wants = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("wanted"))
    second = joined(own, anchors.join(wants, "vec_id"), space, negatives, of_other_labels(low, high), low)
    out = second.withColumnRenamed("score", "negative_score").join(found, ["anchor_id", "place"])
    return out.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", "negative_score")
