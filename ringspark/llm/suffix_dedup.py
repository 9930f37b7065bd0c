"""Removal of long repeated byte strings by fingerprints of strings at anchors.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts anywhere else.  A suffix
array over all bytes would send every position through every sort; here the positions that are
ranked are anchors.  Of the 64-byte strings in each window of 400 bytes the one with the least
fingerprint is the window's anchor, leftmost on ties, so equal windows have their anchors at
equal places and every window belongs to exactly one anchor.  Ranks are 64-bit fingerprints of
the string at a position, and Spark groups equal ranks at growing lengths:

* 64 bytes at each anchor; anchors with a unique rank are done, none of their windows repeats;
* the whole stretch under all windows of an anchor: where it repeats, all these windows do;
* for the anchors left, stretches under 16 neighbouring windows: the 385 bytes that all 16 share
  (unique: none repeats) and the 415 bytes that they cover (repeated: all repeat);
* for the windows left, their own 400 bytes, among those of equal cores.

Each step only counts equal ranks, with partial counts before the shuffle; no pair of positions
is ever formed, so a passage that a third of all documents share costs one row for each place.
What is removed was found equal in two fingerprints, of a string and of one inside it, so texts
that differ can only pass for equal among strings that agree in 64 or 385 bytes already.

:func:`passages` stops before the last step: it finds shared passages of a shorter length and
leaves their borders open by less than 16 bytes.  :func:`digests` uses it to choose the texts
that can lose anything.

Defined results: a null or empty text has nothing to remove; texts of under 400 bytes stay as
they are; identical rows repeat each other; a null id is kept; an empty table gives no rows;
extra columns are not read by :func:`digests` and are kept by :func:`cleaned`, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, fresh, raw_texts, worker_cache

LENGTH, GRAM, STEP = 400, 64, 16
PASSAGE = 250
PIECE = 200_000
WIDEST = 1024
SHIFT = 11
NO_ID = -(1 << 63)
MULTIPLIER = 0x5851F42D4C957F2D


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64."""
    held = worker_cache("suffix powers")
    if not held:
        n = 2 * PIECE + 2 * WIDEST
        held["up"], held["down"] = (np.cumprod(np.r_[np.uint64(1), np.full(n, m, dtype=np.uint64)]) for m in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)))
    return held["up"], held["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0x9E3779B97F4A7C15)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def sums(raw: np.ndarray) -> np.ndarray:
    return np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers()[0][: len(raw)])]


def prints(total: np.ndarray, starts: np.ndarray, ends: np.ndarray, tag: np.ndarray | int = 0) -> np.ndarray:
    """Fingerprints of the strings between places, told apart by their tags as well."""
    value = (total[ends] - total[starts]) * powers()[1][starts]
    return mixed(value + np.asarray(tag).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)).view(np.int64)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, by windows of doubling width."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def anchors_of(raw: np.ndarray, piece: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor, first and last window, rank at the anchor, rank of the stretch.

    raw: pieces of texts end to end; piece: the piece of each byte; ends: where pieces end.
    """
    total = sums(raw)
    at = np.arange(len(raw) - GRAM + 1)
    value = mixed((total[GRAM:] - total[:-GRAM]) * powers()[1][at])
    packed = (value >> np.uint64(20) << np.uint64(20)) | at.astype(np.uint64)
    anchor = (least(packed, length - GRAM + 1) & np.uint64((1 << 20) - 1)).astype(np.int64)
    window = np.flatnonzero(np.arange(len(anchor)) + length <= ends[piece[: len(anchor)]])
    own = anchor[window]
    new = np.r_[True, (own[1:] != own[:-1]) | (window[1:] != window[:-1] + 1)]
    first, last = window[new], window[np.r_[new[1:], True]]
    own = own[new]
    return own, first, last, value[own].view(np.int64), prints(total, first, last + length, (own - first) * WIDEST + (last - first))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, k, text): a row's own key, also where ids are null or repeat."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("k"), text.alias("text"))


def keyed_texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, memoryview]]:
    """(d, k, bytes of the text) of each row."""
    return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2)), strict=True)


def columns(names: str, rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names.split())


def anchor_rows(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(d, k, place, gram, whole) of each anchor; place packs the anchor and its windows."""
    names = "d k place gram whole"

    def flush(pieces: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(p[3]) for p in pieces])
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join([p[3] for p in pieces]), dtype=np.uint8)
        piece = np.repeat(np.arange(len(pieces)), sizes)
        a, s, e, gram, whole = anchors_of(raw, piece, ends, length)
        of = piece[s]
        d, k, base = (np.array([p[i] for p in pieces], dtype=np.int64) for i in range(3))
        place = (a + (base - (ends - sizes))[of] << 2 * SHIFT) | (a - s << SHIFT) | (a - e)
        return columns(names, [(d[of], k[of], place, gram, whole)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held = [], 0
        for batch in batches:
            for d, k, raw in keyed_texts(batch):
                for base in range(0, len(raw) - length + 1, PIECE):
                    part = raw[base : base + PIECE + length - 1]
                    pieces.append((d, k, base, part))
                    held += len(part)
                    if held >= PIECE:
                        yield flush(pieces)
                        pieces, held = [], 0
        if pieces:
            yield flush(pieces)

    return run


def windows_of(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window of packed places."""
    a, part = place >> 2 * SHIFT, (1 << SHIFT) - 1
    return a, a - (place >> SHIFT & part), a - (place & part)


def by_piece(raw: bytes, starts: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(rows, base, sums): which starts lie in each piece of a text, and the piece's sums."""
    at = starts // PIECE
    for piece in np.unique(at):
        base = int(piece) * PIECE
        yield np.flatnonzero(at == piece), base, sums(np.frombuffer(raw[base : base + PIECE + WIDEST], dtype=np.uint8))


def lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """Of a column of lists of numbers or of structs of numbers, each row as a matrix with a line per field."""
    at, values = column.offsets.to_numpy(), column.values
    parts = [values.field(i) for i in range(values.type.num_fields)] if pa.types.is_struct(values.type) else [values]
    fields = np.array([x.to_numpy() for x in parts])
    for a, b in zip(at, at[1:], strict=False):
        yield fields[:, a:b]


def block_rows(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each open anchor the stretches of STEP neighbouring windows.

    place packs the first window of the block, and which of its windows belong to the anchor.
    """
    names = "d k place whole core kind"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for (d, k, raw), own in zip(keyed_texts(batch), lists(batch.column(3)), strict=True):
                if not own.size:
                    continue
                # an anchor on the border of two pieces comes with two ranges
                place, kind = own[:, np.argsort(own[0], kind="stable")]
                a, s, e = windows_of(place)
                new = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                a, s, e, kind = a[new], np.minimum.reduceat(s, new), np.maximum.reduceat(e, new), np.minimum.reduceat(kind, new)
                first, last = (a - e) // STEP, (a - s) // STEP
                count = last - first + 1
                row = np.repeat(np.arange(len(a)), count)
                block = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                lo, hi = a[row] - block * STEP - STEP + 1, a[row] - block * STEP  # first and last window of the block
                inside = (lo >= 0) & (hi + length <= len(raw))
                whole, core = np.zeros(len(row), dtype=np.int64), np.zeros(len(row), dtype=np.int64)
                for some, base, total in by_piece(raw, np.maximum(lo, 0)):
                    tag = block[some] * 2
                    core[some] = prints(total, hi[some] - base, lo[some] + length - base, tag)
                    full = some[inside[some]]
                    whole[full] = prints(total, lo[full] - base, hi[full] + length - base, block[full] * 2 + 1)
                # lo may lie up to STEP - 1 before the text
                at = (lo + STEP << 2 * SHIFT) | (np.maximum(s[row], lo) - lo << SHIFT) | (np.minimum(e[row], hi) - lo)
                rows.append((np.full(len(row), d), np.full(len(row), k), at, np.where(inside, whole, 0), core, kind[row]))
                held += len(row)
                if held > 200_000:
                    yield columns(names, rows)
                    rows, held = [], 0
            if rows:
                yield columns(names, rows)

    return run


def own_windows(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of the packed places of blocks."""
    lo, part = (place >> 2 * SHIFT) - STEP, (1 << SHIFT) - 1
    return lo + (place >> SHIFT & part), lo + (place & part)


def window_rows(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each window of the open blocks: the rank of its block's core, its own, and its kind."""
    names = "d k p core rank kind"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for (d, k, raw), (place, core, kind) in zip(keyed_texts(batch), lists(batch.column(3)), strict=True):
                lo, hi = own_windows(place)
                count = hi - lo + 1
                p = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
                rank = np.zeros(len(p), dtype=np.int64)
                for some, base, total in by_piece(raw, p):
                    rank[some] = prints(total, p[some] - base, p[some] + length - base)
                rows.append((np.full(len(p), d), np.full(len(p), k), p, np.repeat(core, count), rank, np.repeat(kind, count)))
                held += len(p)
                if held > 200_000:
                    yield columns(names, rows)
                    rows, held = [], 0
            if rows:
                yield columns(names, rows)

    return run


def spans_of(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching ranges as maximal ones."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > reach[:-1]]
    return start[new], reach[np.r_[new[1:], True]]


def whole_characters(raw: memoryview, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges without the parts of characters at their ends, which are kept whole.

    A character has at most three bytes after its first.
    """
    own = np.r_[np.frombuffer(raw, dtype=np.uint8), np.zeros(4, dtype=np.uint8)]
    inside = lambda at: own[at] & 0xC0 == 0x80
    for _ in range(3):
        start, end = start + inside(start), end - inside(end)
    some = start < end
    return start[some], end[some]


def kept_rows(by_character: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What is left of each text outside of its ranges; by character, none is cut apart."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                rows = []
                for (d, k, raw), own in zip(keyed_texts(part), lists(part.column(3)), strict=True):
                    start, end = spans_of(*own)
                    if by_character:
                        start, end = whole_characters(raw, start, end)
                    kept = b"".join([raw[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(raw)], strict=True)])
                    rows.append((d, k, len(raw) - len(kept), len(start), kept))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["d", "k", "n_removed", "n_spans", "kept"])

    return run


def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes under the ranges of each text."""
    for batch in batches:
        spans = [spans_of(*own) if own.size else own for own in lists(batch.column(2))]
        n = [int((end - start).sum()) for start, end in spans]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64())], ["d", "k", "n"])


def repeated(df: DataFrame, *by: str) -> DataFrame:
    """The values that occur twice or more, and whether with different ids.

    A row of a kind over 0 stands for all rows with its string, of which there are two or more,
    with different ids if its kind is 2.  What is found is written, so that joins with it can
    split a hot value.
    """
    n, across = F.count("*"), F.min("d") < F.max("d")
    if "kind" in df.columns:
        n, across = F.sum(F.when(F.col("kind") == 0, 1).otherwise(2)), across | (F.max("kind") == 2)
    counted = df.groupBy(*by).agg(n.alias("n"), across.alias("across"))
    return cut(counted.filter("n > 1").select(*by, "across"), f"repeated-{by[-1]}")


def standing(df: DataFrame, *by: str) -> DataFrame:
    """One row (d, k, place, kind) for all rows with the same string, all settled."""
    one = df.groupBy(*by).agg(F.min(F.struct("d", "k", "place")).alias("one"), F.max("across").alias("across"))
    return one.select(*by, "one.*", F.when(F.col("across"), 2).otherwise(1).cast("long").alias("kind"))


def stretches(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts with a tied anchor and their open anchors, their anchors, and the blocks of the open ones.

    (d, k, text, own); (d, k, place, across) with null where not all windows of the anchor repeat;
    (d, k, place, core, whole, kind, across) with null where not all windows of the block repeat.
    Anchors that are settled take part only through one row for all that have the same stretch.
    """
    anchors = cut(docs.mapInArrow(anchor_rows(length), "d long, k long, place long, gram long, whole long"), "anchors")
    again = repeated(anchors, "gram")
    tied = cut(anchors.join(again, "gram", "left_semi"), "tied")
    discard(anchors, again)
    again = repeated(tied, "gram", "whole")
    ranked = cut(tied.join(again, ["gram", "whole"], "left").select("d", "k", "place", "gram", "whole", "across"), "ranked")
    discard(tied, again)
    loose = ranked.filter("across is null")
    open_grams = cut(loose.select("gram").distinct(), "open-grams")
    stand = standing(ranked.filter("across is not null").join(open_grams, "gram", "left_semi"), "gram", "whole").select("d", "k", "place", "kind")
    wanted = loose.select("d", "k", "place", F.lit(0).cast("long").alias("kind")).union(stand)
    wanted = wanted.union(ranked.filter("across is not null").select("d", "k", F.lit(None).cast("long"), F.lit(None).cast("long")))
    own = wanted.groupBy("d", "k").agg(F.collect_set(F.when(F.col("kind").isNotNull(), F.struct("place", "kind"))).alias("own"))
    some = cut(docs.select("d", "k", "text").join(own, ["d", "k"]), "candidates")
    discard(open_grams)
    blocks = cut(some.mapInArrow(block_rows(length), "d long, k long, place long, whole long, core long, kind long"), "blocks")
    again = repeated(blocks.filter("whole <> 0"), "core", "whole")
    flagged = cut(blocks.join(again, ["core", "whole"], "left").select("d", "k", "place", "core", "whole", "kind", "across"), "flagged")
    discard(blocks, again)
    return some, ranked.select("d", "k", "place", "across"), flagged


def full_ranges(ranked: DataFrame, flagged: DataFrame, length: int) -> DataFrame:
    """(d, k, start, end, across) under the anchors and blocks all of whose windows repeat."""
    part, place = (1 << SHIFT) - 1, F.col("place")
    anchor = F.shiftright(place, 2 * SHIFT)
    one = ranked.filter("across is not null").select("d", "k", (anchor - F.shiftright(place, SHIFT).bitwiseAND(part)).alias("start"), (anchor - place.bitwiseAND(part) + length).alias("end"), "across")
    lo = F.shiftright(place, 2 * SHIFT) - STEP
    two = flagged.filter("across is not null and kind = 0").select("d", "k", (lo + F.shiftright(place, SHIFT).bitwiseAND(part)).alias("start"), (lo + place.bitwiseAND(part) + length).alias("end"), "across")
    return one.union(two)


def passages(docs: DataFrame, length: int = PASSAGE) -> DataFrame:
    """(d, k, text, n_passage_bytes) of the texts with long passages that come again.

    Counted is what lies under anchors or blocks all of whose windows repeat with another id; a
    text whose passages come again only with its own id has 0.  Any repeated
    string of ``length + 2 * STEP`` bytes holds such a block, and no string of under ``length``
    bytes counts; only strings between these lengths may or may not.
    """
    some, ranked, flagged = stretches(docs, length)
    ranges = full_ranges(ranked, flagged, length).groupBy("d", "k").agg(F.collect_list(F.when(F.col("across"), F.struct("start", "end"))).alias("own"))
    sizes = ranges.mapInArrow(covered, "d long, k long, n_passage_bytes long").dropDuplicates(["d", "k"])
    out = cut(some.select("d", "k", "text").join(sizes, ["d", "k"]), "passages")
    discard(some, flagged)
    return out


def kept_parts(docs: DataFrame, length: int = LENGTH, by_character: bool = False) -> DataFrame:
    """(d, k, n_removed, n_spans, kept) of the texts that lose something; docs as by :func:`keyed`."""
    if not GRAM < length <= WIDEST - 2 * STEP:
        raise ValueError(f"the length must be over {GRAM} and at most {WIDEST - 2 * STEP}")
    some, ranked, flagged = stretches(docs, length)
    weight, loose = F.when(F.col("kind") == 0, 1).otherwise(2), F.when((F.col("kind") == 0) & F.col("across").isNull(), 1)
    open_cores = cut(flagged.groupBy("core").agg(F.sum(weight).alias("n"), F.count(loose).alias("loose")).filter("n > 1 and loose > 0").select("core"), "open-cores")
    tied = cut(flagged.join(open_cores, "core", "left_semi"), "tied-blocks")
    settled = tied.filter("kind > 0 or across is not null").withColumn("across", F.coalesce("across", F.col("kind") == 2))
    stand = standing(settled.filter("whole <> 0"), "core", "whole").select("d", "k", "place", "core", "kind")
    wanted = tied.filter("kind = 0 and across is null").union(settled.filter("whole = 0")).select("d", "k", "place", "core", "kind").union(stand)
    left = wanted.groupBy("d", "k").agg(F.collect_set(F.struct("place", "core", "kind")).alias("own"))
    windows = cut(some.select("d", "k", "text").join(left, ["d", "k"]).mapInArrow(window_rows(length), "d long, k long, p long, core long, rank long, kind long"), "windows")
    ranks = repeated(windows, "core", "rank")
    again = cut(windows.filter("kind = 0").join(ranks, ["core", "rank"], "left_semi").select("d", "k", "p"), "again")
    discard(windows, ranks, open_cores, tied)
    ranges = full_ranges(ranked, flagged, length).drop("across").union(again.select("d", "k", F.col("p").alias("start"), (F.col("p") + length).alias("end")))
    removed = ranges.groupBy("d", "k").agg(F.collect_list(F.struct("start", "end")).alias("own"))
    kept = some.select("d", "k", "text").join(removed, ["d", "k"]).mapInArrow(kept_rows(by_character), "d long, k long, n_removed long, n_spans long, kept binary")
    return kept.dropDuplicates(["d", "k"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes) for every document.

    n_passage_bytes counts the bytes of passages shared with other ids, which may be too short to
    be removed, see :func:`passages`.  Texts without any passage that comes again cannot hold a
    repeated string of ``length`` bytes, so the removal reads only the others; ``length`` must be at least ``passage + 2 * STEP``.
    """
    if length < passage + 2 * STEP:
        raise ValueError(f"the length must be at least {passage + 2 * STEP}")
    rows = keyed(docs, id_col, text_col)
    some = passages(rows, passage)
    lost = kept_parts(some.select("d", "k", "text"), length).select("d", "k", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    found = some.select("d", "k", "n_passage_bytes").dropDuplicates(["d", "k"]).join(lost, ["d", "k"], "left")
    all_rows = rows.select("d", "k", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256"))
    zero = F.lit(0).cast("long")
    named = all_rows.join(found, ["d", "k"], "left")
    return named.select(F.nullif("d", F.lit(NO_ID)).alias("doc_id"), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), F.coalesce("n_passage_bytes", zero).alias("n_passage_bytes"))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", length: int = LENGTH) -> DataFrame:
    """The same rows and columns, with what repeats cut out of the texts.

    Texts are cut between characters only: a character that a repeated string covers in part
    stays whole, so everything outside of repeated strings is kept as it was.
    """
    key_d, key_k, fixed_text = (fresh(docs, c) for c in ("d", "k", "kept"))
    lost = kept_parts(keyed(docs, id_col, text_col), length, by_character=True)
    fixed = lost.select(F.col("d").alias(key_d), F.col("k").alias(key_k), F.col("kept").cast("string").alias(fixed_text))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    marked = docs.withColumn(key_d, F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID))).withColumn(key_k, F.xxhash64(text))
    out = marked.join(fixed, [key_d, key_k], "left").withColumn(text_col, F.coalesce(fixed_text, text_col))
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col(fixed_text).isNull(), F.col(chars_col)).otherwise(F.length(fixed_text)).cast(docs.schema[chars_col].dataType))
    return out.select(*docs.columns)
