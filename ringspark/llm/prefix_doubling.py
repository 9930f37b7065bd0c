"""Repeated byte strings by prefix doubling over every position: exact, and large on disk.

Every position starts with the rank of the 64 bytes there.  In each round the positions whose
rank is unique leave, and the ranks of a position and of the one an offset further on make a
pair; the pairs are ranked anew.  Offsets double until the length is reached (64, 128, 144 for
400 bytes).  A rank is a 64-bit name of its pair, so no order of all pairs is needed to tell
which are equal; Spark's grouping counts them, partially before the shuffle.

No query uses it: it writes every position of every text several times, see the README for how
many bytes.  :mod:`.suffix_dedup` removes the same bytes from anchors.

Defined results: as for :func:`.suffix_dedup.digests`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard
from .suffix_dedup import GRAM, LENGTH, PIECE, columns, kept_rows, mixed, powers, sums


def position_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, k, n, p, rank) of every position with GRAM bytes."""
    for batch in batches:
        for d, k, copies, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode()
            for base in range(0, len(raw) - GRAM + 1, PIECE):
                total = sums(np.frombuffer(raw[base : base + PIECE + GRAM - 1], dtype=np.uint8))
                n = len(total) - GRAM
                rank = mixed((total[GRAM:] - total[:-GRAM]) * powers()[1][:n]).view(np.int64)
                yield columns("d k n p rank", [(np.full(n, d), np.full(n, k), np.full(n, copies), base + np.arange(n), rank)])


def tied(ranks: DataFrame, label: str) -> DataFrame:
    """The positions whose rank others have too."""
    again = cut(ranks.groupBy("rank").agg(F.sum("n").alias("n")).filter("n > 1").select("rank"), f"ties-{label}")
    out = cut(ranks.join(again, "rank", "left_semi").select("d", "k", "n", "p", "rank"), f"tied-{label}")
    discard(again)
    return out


def repeated_positions(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(d, k, p) where a string of ``length`` bytes starts that starts elsewhere too."""
    once = docs.groupBy("d", "k").agg(F.count("*").alias("n"), F.min("text").alias("text"))
    ranks = cut(once.mapInArrow(position_rows, "d long, k long, n long, p long, rank long"), "positions")
    have = GRAM
    at = tied(ranks, str(have))
    discard(ranks)
    while have < length:
        offset = min(have, length - have)
        further = at.select("d", "k", (F.col("p") - offset).alias("p"), F.col("rank").alias("next"))
        paired = cut(at.join(further, ["d", "k", "p"]).select("d", "k", "n", "p", F.xxhash64("rank", "next").alias("rank")), "pairs")
        discard(at)
        have += offset
        at = tied(paired, str(have))
        discard(paired)
    return at.select("d", "k", "p")


def kept_parts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(d, k, n_removed, n_spans, kept) of the texts that lose something; docs as by ``keyed``.

    Rows with the same id and text count as different places.
    """
    if length < GRAM:
        raise ValueError(f"the length must be at least {GRAM}")
    found = repeated_positions(docs, length)
    ranges = found.groupBy("d", "k").agg(F.collect_list(F.struct(F.col("p").alias("start"), (F.col("p") + length).alias("end"))).alias("own"))
    return docs.select("d", "k", "text").join(ranges, ["d", "k"]).mapInArrow(kept_rows(), "d long, k long, n_removed long, n_spans long, kept binary").dropDuplicates(["d", "k"])

