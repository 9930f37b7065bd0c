"""Best-fit packing: a configuration linear program over the length histogram.

Documents become token pieces of at most ``capacity``; only the histogram of piece lengths (at
most ``capacity`` numbers) reaches the driver.  There a configuration is a multiset of lengths
that fits into one sequence; the linear program asks for the fewest configurations that cover
the histogram.  Multiplicative weights give every length a price that falls as it gets covered,
a knapsack dynamic program prices out the dearest configurations, until the covering solution is
within GAP of its lower bound; it is rounded to whole configurations, and the program is solved
again for the rest.  The last REST of the tokens are completed in the same histogram form, longest
first with an exact filling where there is one.  Pieces are then dealt to the slots of the configurations by
their rank within their length, found from sharded row numbers, so a length that holds a third
of all rows is never in one task.

Defined results: a null or empty text is the piece of the separator alone; repeated rows are
packed as often as they come; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, texts, worker_cache

SEPARATOR = 0
CACHE_ENTRIES = 700_000
BLOCK_BYTES = 4_000_000
SHARD_ROWS = 50_000
# The linear program: rounds at first and for what is left, tokens added in a round as a share of
# all, the gap to the lower bound, the share of the sequences that one solution gives, what a
# rounded configuration may leave free, as a share of the capacity, and the share of the tokens
# that is left to complete.
ROUNDS, AGAIN, STEP, GAP, SHARE, WASTE, REST = 600, 200, 0.005, 0.05, 0.5, 0.008, 0.08
RANKS = 1 << 48
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def composed(chunk: str) -> bool:
    """Whether normalisation only lowers the letters: composed ones, none beyond Latin."""
    return max(chunk) < "\u0250" and "\u0130" not in chunk and unicodedata.is_normalized("NFC", chunk)


class ChunkEncoder:
    """Ids by the tokenizer's own encoder, kept for each chunk between blanks.

    The tokenizer drops white space and no pre-token or normalisation reaches across it, so a
    text's ids are those of its chunks in order.  New chunks are cut into pre-tokens, and the
    new ones among these go through the encoder joined by blanks: each ends with the one id
    that carries the end of a word.  Chunks with special strings or letters beyond Latin are
    encoded as they are; so are texts with the four separators that Python splits at though
    they are no white space to the tokenizer, and all texts if the tokenizer file has another
    pattern or normalisation than these.
    """

    # Fixed values of the tokenizer: its pre-token pattern, its normalisation, the end of a word.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    NORMALISED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    SPLIT = [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    END = "</w>"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as file:
            own = json.load(file)
        model = own["model"]
        self.known = (own["normalizer"] or {}).get("normalizers") == self.NORMALISED and (own["pre_tokenizer"] or {}).get("pretokenizers") == self.SPLIT and model["type"] == "BPE" and model.get("end_of_word_suffix") == self.END and not model.get("dropout")
        self.known = self.known and all(t["special"] and "<|" in t["content"] for t in own["added_tokens"])
        self.find = regex.compile(self.PATTERN).findall
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(self.END)]] = True

    def direct(self, some: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(some, add_special_tokens=False)]

    def settle(self, chunks: set[str]) -> None:
        """Put the ids of every chunk into the cache.

        Most chunks are one word, or one with a full stop or comma behind it; these need no
        pattern.  A word of composed Latin letters is only lowered by the normalisation.
        """
        words, ended, bare, own, odd = [], [], [], [], []
        for c in chunks:
            if c.isalpha():
                if c.isascii() or composed(c):
                    words.append(c)
                else:
                    odd.append(c)
            elif not c.isascii() and not composed(c) or "<|" in c:
                odd.append(c)
            elif c[-1] in ".," and (word := c[:-1]).isalpha():
                ended.append(c)
                bare.append(word.lower())
            else:
                own.append(c)
        lowered = list(map(str.lower, words))
        pieces = [self.find(c.lower()) for c in own]
        if len(self.parts) > CACHE_ENTRIES:
            self.parts.clear()
        new = list({".", ",", *lowered, *bare, *chain.from_iterable(pieces)} - self.parts.keys())
        for i in range(0, len(new), 5_000):
            some = new[i : i + 5_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            to = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            if len(to) == len(some):
                self.parts.update(zip(some, map(raw.__getitem__, map(slice, [0, *to], to)), strict=False))
            else:  # some letter has no end-of-word form
                self.parts.update(zip(some, self.direct(some), strict=True))
        get, cache = self.parts.__getitem__, self.cache
        cache.update(zip(words, map(get, lowered), strict=True))
        marks = {m: get(m) for m in ".,"}
        cache.update(zip(ended, [get(p) + marks[c[-1]] for c, p in zip(ended, bare, strict=True)], strict=True))
        cache.update(zip(own, [b"".join(map(get, p)) for p in pieces], strict=True))
        if odd:
            cache.update(zip(odd, self.direct(odd), strict=True))

    def encode(self, block: list[str]) -> list[bytes]:
        if not self.known:
            return self.direct(block)
        odd = {t for t in block if any(c in t for c in "\x1c\x1d\x1e\x1f")}
        chunks = [[] if t in odd else t.split() for t in block]
        unseen = set().union(*chunks) - self.cache.keys()
        if len(self.cache) + len(unseen) > CACHE_ENTRIES:
            self.cache.clear()
            unseen = set().union(*chunks)
        self.settle(unseen)
        get = self.cache.__getitem__
        return [self.direct([t])[0] if t in odd else b"".join(map(get, c)) for t, c in zip(block, chunks, strict=True)]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_cache(f"chunks:{tokenizer_path}")
        if "encoder" not in held:
            held["encoder"] = ChunkEncoder(tokenizer_path)
        encoder, tail, wide = held["encoder"], np.uint32(SEPARATOR).tobytes(), 4 * capacity

        def flush(keys: list, block: list[str]) -> pa.RecordBatch:
            rows: list[tuple] = []
            for key, ids in zip(keys, encoder.encode(block), strict=True):
                ids += tail
                for n, at in enumerate(range(0, len(ids), wide)):
                    part = ids[at : at + wide]
                    rows.append((key, n, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

        for batch in batches:
            keys, block, held_bytes = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(key)
                block.append(text)
                held_bytes += len(text)
                if held_bytes >= BLOCK_BYTES:
                    yield flush(keys, block)
                    keys, block, held_bytes = [], [], 0
            if keys:
                yield flush(keys, block)

    return texts(docs, id_col, text_col).mapInArrow(run, PIECE_SCHEMA)


def knapsack(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each room the greatest price of copies of lengths that fit, and the length to take first.

    prices are by length, minus infinity for lengths that are not there; 0 is no length.
    """
    best, take = np.zeros(len(prices)), np.zeros(len(prices), dtype=np.int64)
    for room in range(1, len(prices)):
        value = best[:room][::-1] + prices[1 : room + 1]
        i = int(value.argmax())
        best[room], take[room] = (value[i], i + 1) if value[i] > best[room - 1] else (best[room - 1], take[room - 1])
    return best, take


def fractional(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[dict[bytes, float], float]:
    """The covering program by multiplicative weights: the mass of each configuration, and the gap.

    A length's price is its share of the capacity times a weight that falls exponentially with
    what is covered of it.  Each round finds, by one knapsack program, the dearest configuration
    with each length, and adds them so that they hold STEP of all tokens; lengths that are ahead
    of the mean are left out, or small pieces would be promised to every gap.  Masses are scaled
    so that the least covered length is covered once; the gap is their sum over the greatest lower
    bound that the prices gave, less one, and rounds end when it is at most GAP.
    """
    share, cover, value = sizes / capacity, np.zeros(len(sizes)), 0.0
    least = bound = float((counts * share).sum())
    found: dict[bytes, float] = {}
    for n in range(rounds):
        behind = cover <= (n + 2) * STEP
        own, weight = sizes[behind], np.maximum(np.exp((cover.min() - cover[behind]) / STEP), 1e-6)
        prices = np.full(capacity + 1, -np.inf)
        prices[own] = share[behind] * weight
        best, take = knapsack(prices)
        bound = max(bound, float((counts[behind] * prices[own]).sum() / (prices[own] + best[capacity - own]).max()))
        rows, room = [own], capacity - own
        while (more := take[room]).any():
            rows.append(more)
            room = room - more
        own = np.stack(rows)
        mass = counts[behind] * weight
        used = np.bincount(own.ravel(), np.broadcast_to(mass, own.shape).ravel(), capacity + 1)[sizes]
        scale = STEP * least / (share * used).sum()
        cover += used * scale / counts
        value += float(mass.sum() * scale)
        raw, wide = np.sort(own, axis=0).T.astype(">u4").tobytes(), 4 * len(own)
        for i, m in enumerate((mass * scale).tolist()):
            key = raw[i * wide : (i + 1) * wide].lstrip(b"\0")
            found[key] = found.get(key, 0.0) + m
        if value <= bound * (1 + GAP) * cover.min():
            break
    return {key: m / cover.min() for key, m in found.items()}, value / cover.min() / bound - 1


def lengths_of(key: bytes) -> np.ndarray:
    return np.frombuffer(key.rjust(-(-len(key) // 4) * 4, b"\0"), dtype=">u4").astype(np.int64)


def topped_up(parts: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """A configuration with one or two more pieces of what is left that fill it, if there are such."""
    if not (room := capacity - int(parts.sum())):
        return parts
    if left[room]:
        return np.r_[parts, room]
    half = np.arange(1, room // 2 + 1)
    pairs = half[(left[half] > 0) & (left[room - half] > 0)]
    return np.r_[parts, room - pairs[0], pairs[0]] if pairs.size else parts


def rounded(left: np.ndarray, capacity: int) -> Iterator[tuple[int, tuple[tuple[int, int], ...]]]:
    """Whole numbers of configurations from the program; what they hold is taken off ``left``.

    Configurations come by their longest piece, long ones first, as these have the fewest partners,
    then by mass, each as often as its mass, rounded down but at least once, and what is left
    allow; places that one leaves free are filled by one or two pieces of what is left.  After SHARE
    of the sequences the program is solved again for the rest, until little is
    left; when it gives next to nothing, configurations may leave a few places free.
    """
    slack, rounds, size = 0, ROUNDS, np.arange(capacity + 1)
    enough = REST * int((left * size).sum())
    while slack <= capacity * WASTE and (tokens := int((left * size).sum())) > enough:
        sizes = np.flatnonzero(left)
        program, _ = fractional(sizes, left[sizes].astype(float), capacity, rounds)
        longest = {key: int.from_bytes(key[-4:]) for key in program}
        made, most = 0, SHARE * tokens / capacity
        for key in sorted(program, key=lambda key: (-longest[key], -program[key], key)):
            if not left[longest[key]]:
                continue
            parts = lengths_of(key)
            if left[parts].all() and capacity - (parts := topped_up(parts, left, capacity)).sum() <= slack:
                lengths, copies = np.unique(parts, return_counts=True)
                if (times := min(max(int(program[key]), 1), int((left[lengths] // copies).min()))) > 0:
                    left[lengths] -= times * copies
                    made += times
                    yield times, tuple(zip(lengths.tolist(), copies.tolist(), strict=True))
                    if made >= most:
                        break
        if made < 0.02 * tokens / capacity:
            slack = 2 * slack + 1
        rounds = AGAIN


Plan = list[tuple[str, int, tuple[tuple[int, int], ...]]]


def configurations(histogram: dict[int, int], capacity: int) -> Plan:
    """(origin, number of sequences, ((length, copies), ...)): together exactly the histogram.

    origin: ``full`` for pieces that fill a sequence, ``program`` for rounded configurations of
    the linear program, ``rest`` for those that complete it.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: Plan = []
    if left[capacity]:
        out.append(("full", int(left[capacity]), ((capacity, 1),)))
        left[capacity] = 0
    out += [("program", times, own) for times, own in rounded(left, capacity)]
    while (there := np.flatnonzero(left)).size:
        own = {int(there[-1]): 1}
        room = capacity - int(there[-1])
        free = left.copy()
        free[there[-1]] -= 1
        while room and (fits := np.flatnonzero(free[: room + 1])).size:
            if free[room]:
                size = room
            else:
                pair = fits[free[room - fits] > (fits * 2 == room)]
                size = int(pair[-1]) if pair.size else int(fits[-1])
            own[size] = own.get(size, 0) + 1
            free[size] -= 1
            room -= size
        times = min(int(left[s]) // n for s, n in own.items())
        out.append(("rest", times, tuple(own.items())))
        for s, n in own.items():
            left[s] -= times * n
    return out


def origins(plan: Plan) -> dict[str, int]:
    """Sequences by origin."""
    out: dict[str, int] = {}
    for origin, times, _ in plan:
        out[origin] = out.get(origin, 0) + times
    return out


def slots(plan: Plan) -> dict[str, np.ndarray]:
    """A row for each length of each configuration: from which rank on, copies, first sequence, offset."""
    filled: dict[int, int] = {}
    rows, sequence = [], 0
    for _, times, own in plan:
        at = 0
        for length, copies in own:
            rows.append((length * RANKS + filled.get(length, 0), copies, sequence, at))
            filled[length] = filled.get(length, 0) + times * copies
            at += length * copies
        sequence += times
    rows.sort()
    return dict(zip(("key", "copies", "sequence", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 4).T, strict=True))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with the sequence and the offset that they are packed at."""
    pieces = cut(token_pieces(docs, tokenizer_path, capacity, id_col, text_col), "pieces", batch_rows=None)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    where = slots(configurations(histogram, capacity))
    shards = -(-sum(histogram.values()) // SHARD_ROWS) or 1
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sharded.groupBy("shard", "length").agg(F.count("*").alias("n")).select("shard", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = sharded.withColumn("nth", F.row_number().over(within)).join(base, ["shard", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            row = np.searchsorted(where["key"], length * RANKS + rank, side="right") - 1
            nth = length * RANKS + rank - where["key"][row]
            sequence = where["sequence"][row] + nth // where["copies"][row]
            offset = where["offset"][row] + nth % where["copies"][row] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECE_SCHEMA + ", sequence_id long, offset long")
