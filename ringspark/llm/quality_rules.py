"""Quality rules: counting rules and a hashed n-gram log-likelihood ratio.

Words are runs of characters other than ASCII blanks.  Every document's single words and word
pairs fall into ``BUCKETS`` hashed cells.  Over all documents the cells are counted once for the
raw corpus, and once for the trusted documents (a bounded, documented sample of the labelled
good ones); both counts become smoothed multinomials.  A document's ratio is the mean over its
words and pairs of log(trusted / raw), so its length cancels out, and it is kept if that mean
reaches a fixed threshold and no counting rule fails.  No draw is made: equal texts get equal
verdicts.

Defined results: a null or empty text has no words, ratio 0 and fails the base rule; without
labels the ratio is 0 everywhere; repeated rows are counted as often as they come; extra
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, worker_cache

BUCKETS = 1 << 14
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
TRUSTED_ROWS = 20_000
THRESHOLD = -0.06
BLOCK_BYTES = 4_000_000
WORDS = 400_000
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double"


class Lexicon:
    """Numbers and hashes of words, kept by the worker; numbers stay below 2^21."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.hashes = np.zeros(0, dtype=np.uint64)

    def take(self, block: list[list[bytes]]) -> None:
        if len(self.number) > WORDS:
            self.number.clear()
            self.hashes = self.hashes[:0]
        new = list(set().union(*block) - self.number.keys())
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        crc = np.fromiter(map(zlib.crc32, new), dtype=np.uint64, count=len(new))
        self.hashes = np.r_[self.hashes, (crc + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))

    def cells(self, numbers: np.ndarray) -> np.ndarray:
        """Cells of the single words and of the pairs."""
        h = self.hashes[numbers]
        pairs = (h[:-1] * np.uint64(31) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (np.r_[h, pairs] >> np.uint64(50)).astype(np.int64)


def repeated(numbers: np.ndarray) -> int:
    """Words in three-word windows that occur twice or more."""
    n = len(numbers)
    if n < 4:
        return 0
    if numbers.max() >= 1 << 21:  # a text of over two million different words
        _, numbers = np.unique(numbers, return_inverse=True)
        _, pair = np.unique(numbers[:-1] * n + numbers[1:], return_inverse=True)
        key = pair[:-1] * n + numbers[2:]
    else:
        key = numbers[:-2] << 42 | numbers[1:-1] << 21 | numbers[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    starts = order[np.r_[False, same] | np.r_[same, False]]
    inside = np.zeros(n, dtype=bool)
    for i in range(3):
        inside[starts + i] = True
    return int(inside.sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def base(text: str, words: list[bytes], numbers: np.ndarray) -> tuple[int, int, int, int, int, bool]:
    n, again = len(words), repeated(numbers)
    return n, len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), again, n < 50 or 100 * again > 50 * n


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str], list[list[bytes]]]]:
    """Rows of a batch in runs of about BLOCK_BYTES, with their words."""
    held, first = 0, 0
    rows = batch.column(1).to_pylist()
    for i, text in enumerate(rows):
        held += len(text)
        if held >= BLOCK_BYTES or i == len(rows) - 1:
            some = rows[first : i + 1]
            yield list(range(first, i + 1)), some, [t.encode().split() for t in some]
            held, first = 0, i + 1


def trusted_sample(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """At most ``rows`` ids labelled good, the same ones in every run."""
    ids = labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def cell_counts(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """(BUCKETS, 2): how often each cell occurs in all documents and in the trusted ones.

    Each task sends one row for each cell at most, so what is collected has a fixed size.
    """
    flagged = texts(docs).join(F.broadcast(trusted.withColumn("good", F.lit(True))), "doc_id", "left").select("doc_id", "text", F.col("good").isNotNull().alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = worker_cache("words").setdefault("lexicon", Lexicon())
        raw, good = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            marks = batch.column(2).to_pylist()
            for at, _, words in blocks(batch):
                lexicon.take(words)
                for i, w in zip(at, words, strict=True):
                    if w:
                        own = np.bincount(lexicon.cells(lexicon.numbers(w)), minlength=BUCKETS)
                        raw += own
                        if marks[i]:
                            good += own
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(good[used])], ["cell", "n_raw", "n_good"])

    out = np.zeros((BUCKETS, 2), dtype=np.int64)
    for r in flagged.mapInArrow(run, "cell long, n_raw long, n_good long").groupBy("cell").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_good").alias("n_good")).collect():
        out[r["cell"]] = r["n_raw"], r["n_good"]
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """log(trusted / raw) of each cell, both smoothed by one; zeros if nothing is trusted."""
    if not counts[:, 1].sum():
        return np.zeros(len(counts))
    p = (counts + 1.0) / (counts.sum(axis=0) + len(counts))
    return np.log(p[:, 1]) - np.log(p[:, 0])


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The counting rules' figures, the ratio and the verdict for every document."""
    ratios = log_ratios(cell_counts(docs, trusted_sample(labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = worker_cache("words").setdefault("lexicon", Lexicon())
        for batch in batches:
            ids = batch.column(0)
            for at, rows, words in blocks(batch):
                lexicon.take(words)
                out = []
                for text, w in zip(rows, words, strict=True):
                    numbers = lexicon.numbers(w)
                    figures = base(text, w, numbers)
                    ratio = float(ratios[lexicon.cells(numbers)].mean()) if w else 0.0
                    out.append((*figures, not figures[-1] and ratio >= threshold, ratio))
                kinds = (*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64())
                yield pa.RecordBatch.from_arrays([ids.slice(at[0], len(at)), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio"])

    return texts(docs).mapInArrow(run, SCHEMA)
