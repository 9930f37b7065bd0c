"""Token counts under a byte-fallback BPE piece model, by rank-synchronous array merging.

Texts are cut into pre-tokens (a run of blanks and what follows it; no piece of the model
holds a blank after another character, so no merge crosses such a border).  Pre-tokens not
seen before by the worker are merged together: their symbols lie in one flat numpy array with
a segment number each; in every round each segment's best-ranked, leftmost pair is merged, all
segments at once, until no pair is left.  What counts is the number of surviving symbols, and
for symbols outside the vocabulary the number of their UTF-8 bytes.

Defined results: a null or empty text has 0 bytes and 0 tokens; rows repeat as they come; a
null id stays null; other columns are not read.  Very long pre-tokens (over ``LONG`` characters)
take the same merges from a priority queue, which needs n log n rather than n^2 steps.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts, worker_cache

BLANK = "▁"
LONG = 256
CACHE_ENTRIES = 500_000
BLOCK_BYTES = 4_000_000
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
NONE = np.int32(2**31 - 1)


class PieceMerger:
    """The merge rules of a sentencepiece BPE model as arrays."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        symbols = [*score, *sorted({c for p in score for c in p} - score.keys())]
        number = {s: i for i, s in enumerate(symbols)}
        self.size = len(symbols) + 1  # the last number: any other character
        pairs = sorted((number[p[:i]] * self.size + number[p[i:]], order[score[p]], number[p]) for p in score for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
        self.rule = {k: (r, m) for k, r, m in pairs}
        keys = np.array([k for k, _, _ in pairs], dtype=np.int64)
        self.keys, self.ranks, self.merged = np.full(SLOTS, -1, dtype=np.int64), np.full(SLOTS, NONE), np.zeros(SLOTS, dtype=np.int32)
        for k, slot in zip(keys.tolist(), self.slot(keys).tolist(), strict=True):
            while self.keys[slot] >= 0:  # open addressing: on to the next free slot
                slot = (slot + 1) % SLOTS
            self.keys[slot], (self.ranks[slot], self.merged[slot]) = k, self.rule[k]
        self.of_char = np.full(0x110000, self.size - 1, dtype=np.int32)
        for s, i in number.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.known = np.zeros(self.size, dtype=bool)
        self.known[: len(score)] = True

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where there is no rule) and merged symbol of each pair."""
        key = left.astype(np.int64) * self.size + right
        at = self.slot(key)
        found = self.keys[at]
        ask = np.flatnonzero((found != key) & (found >= 0))
        while len(ask):
            at[ask] = (at[ask] + 1) % SLOTS
            found = self.keys[at[ask]]
            ask = ask[(found != key[ask]) & (found >= 0)]
        return self.ranks[at], self.merged[at]

    def count(self, tokens: list[str]) -> np.ndarray:
        """Surviving symbols of each non-empty pre-token."""
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        code = np.frombuffer("".join(tokens).encode("utf-32-le"), dtype=np.uint32)
        sym, seg = self.of_char[code], np.repeat(np.arange(len(tokens), dtype=np.int32), sizes)
        width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        out = np.add.reduceat(np.where(self.known[sym], 1, width).astype(np.int64), np.cumsum(sizes) - sizes)
        wide = np.flatnonzero(~self.known[sym] & (sym < self.size - 1))  # parts of pieces that are no pieces
        weight = np.ones(self.size, dtype=np.int64)
        weight[sym[wide]] = width[wide]
        rank = np.full(len(sym), NONE)
        inner = np.flatnonzero(seg[1:] == seg[:-1])
        rank[inner] = self.look_up(sym[inner], sym[inner + 1])[0]
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(sym)]))
            keep = least != NONE  # the other segments are done
            at = np.flatnonzero((rank == least) & keep)
            if not len(at):
                break
            at = at[np.r_[True, seg[at[1:]] != seg[at[:-1]]]]  # the leftmost of each segment
            left, right = sym[at], sym[at + 1]
            out[seg[at]] += 1 - weight[left] - weight[right]
            sym[at] = self.look_up(left, right)[1]
            keep[at + 1] = False
            at = np.cumsum(keep)[at] - 1
            sym, seg, rank = sym[keep], seg[keep], rank[keep]
            p = np.r_[at, at[at > 0] - 1]
            rank[p] = NONE
            p = p[p + 1 < len(sym)]
            p = p[seg[p] == seg[p + 1]]
            rank[p] = self.look_up(sym[p], sym[p + 1])[0]
        return out

    def count_long(self, token: str) -> int:
        code = np.frombuffer(token.encode("utf-32-le"), dtype=np.uint32)
        sym = self.of_char[code].tolist()
        n = len(sym)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (hit := self.rule.get(sym[i] * self.size + sym[after[i]])):
                heapq.heappush(heap, (hit[0], i, sym[i], sym[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], alive[j], after[i] = self.rule[a * self.size + b][1], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return sum(1 if self.known[s] else len(c.encode()) for s, c, live in zip(sym, token, alive, strict=True) if live)


def split(text: str) -> list[str]:
    """Pre-tokens of a text, each with its leading blanks."""
    if not text:
        return []
    marked = BLANK + text.replace(" ", BLANK)
    if BLANK * 2 in marked or marked[-1] == BLANK:
        return re.findall(f"{BLANK}*[^{BLANK}]+|{BLANK}+", marked)
    return marked.replace(BLANK, " " + BLANK)[1:].split(" ")


def settle(model: PieceMerger, cache: dict[str, int], words: set[str]) -> None:
    """Put the count of every word into the cache.  A newline is no part of any piece."""
    parts = {p for w in words for p in w.split("\n") if p} - cache.keys()
    short = [p for p in parts if len(p) <= LONG]
    for i in range(0, len(short), 50_000):
        some = short[i : i + 50_000]
        cache.update(zip(some, model.count(some).tolist(), strict=True))
    for p in parts:
        if len(p) > LONG:
            cache[p] = model.count_long(p)
    cache[""] = 0
    for w in words:
        if "\n" in w:
            cache[w] = sum(cache[p] for p in w.split("\n")) + w.count("\n")


def blocks(rows: list[str], sizes: list[int]) -> Iterator[list[str]]:
    """Runs of texts of about ``BLOCK_BYTES`` together, so that many pre-tokens are merged at once."""
    block, held = [], 0
    for text, size in zip(rows, sizes, strict=True):
        block.append(text)
        held += size
        if held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_cache(f"pieces:{model_path}")
        if "model" not in held:
            held["model"], held["counts"] = PieceMerger(model_path), {}
        model, cache = held["model"], held["counts"]
        for batch in batches:
            rows = batch.column(1).to_pylist()
            n_tokens, n_bytes = [], [len(text.encode()) for text in rows]
            for block in blocks(rows, n_bytes):
                words = [split(text) for text in block]
                unseen = set().union(*words) - cache.keys()
                if len(cache) + len(unseen) > CACHE_ENTRIES:
                    cache.clear()
                    unseen = set().union(*words)
                settle(model, cache, unseen)
                n_tokens += [sum(map(cache.__getitem__, w)) for w in words]
            tokens = pa.array(n_tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), tokens, pa.array([n > limit for n in n_tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
