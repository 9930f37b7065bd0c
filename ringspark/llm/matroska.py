"""Media columns as Matroska: write payloads as PCM tracks, parse the bytes into packet tables.

The writer stores a payload as 8-bit unsigned samples (8000 a second, so 192 bytes are 24 ms):
frames of 192 bytes, eight to a fixed-laced SimpleBlock, 32 blocks to a cluster, one cue for
each cluster.  The parser follows the published element structure: variable-length ids and
sizes, unknown sizes, SimpleBlocks and BlockGroups, all four lacings, cues; it yields one row
for each packet with track, timestamp and byte range, and never looks at what was written.
Frames of a lace follow each other by their track's default duration; in a track without one
they all have the block's time.

Defined results: a null or empty text is stored as one frame of blanks; equal texts give equal
bytes; rows repeat as they come; a null id stays null; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

FRAME, LACED, BLOCKS, FRAME_MS, RATE = 192, 8, 32, 24, 8000
# Fixed values of the container format: element ids.
EBML, DOCTYPE, SEGMENT, INFO, SCALE, DURATION = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK, NUMBER, UID, KIND, LASTS, CODEC, AUDIO, HERTZ, CHANNELS, DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x23E383, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, STAMP, SIMPLE, GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE, CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_AT}
LACINGS = ("none", "xiph", "fixed", "ebml")


class Packet(NamedTuple):
    track: int
    timestamp: int
    start: int
    length: int
    lacing: str
    cluster: int


class Media(NamedTuple):
    packets: list[Packet]
    cues: list[tuple[int, int, int]]
    doctype: str
    codec: str
    depth: int
    duration: float
    blocks: int
    clusters: int
    lasts: dict[int, int]


def vint(n: int) -> bytes:
    """A size in as few bytes as hold it; a value of ones only means an unknown size."""
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def element(number: int, body: bytes) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(number: int, value: int, width: int = 0) -> bytes:
    return element(number, value.to_bytes(width or max(1, (value.bit_length() + 7) // 8), "big"))


HEAD = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(DOCTYPE, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
TRACK_LIST = element(TRACKS, element(TRACK, uint(NUMBER, 1) + uint(UID, 1) + uint(KIND, 2) + uint(LASTS, FRAME_MS * 1_000_000) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(HERTZ, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(DEPTH, 8))))


def pad(payload: bytes) -> bytes:
    return payload + b" " * (FRAME if not payload else -len(payload) % FRAME)


def write(payload: bytes) -> bytes:
    """A whole file; the payload's length is a positive multiple of the frame size."""
    frames = len(payload) // FRAME
    clusters, stamps = [], []
    for first in range(0, frames, LACED * BLOCKS):
        stamp, body = first * FRAME_MS, []
        for at in range(first, min(first + LACED * BLOCKS, frames), LACED):
            n = min(LACED, frames - at)
            head = b"\x81" + struct.pack(">h", at * FRAME_MS - stamp) + (bytes([0x84, n - 1]) if n > 1 else b"\x80")
            body.append(element(SIMPLE, head + payload[at * FRAME : (at + n) * FRAME]))
        stamps.append(stamp)
        clusters.append(element(CLUSTER, uint(STAMP, stamp) + b"".join(body)))
    info = element(INFO, uint(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", frames * FRAME_MS)) + element(0x4D80, b"spark") + element(0x5741, b"spark"))
    # cue positions have eight bytes, so the cues' own length is known before they are
    cues = lambda places: element(CUES, b"".join(element(CUE, uint(CUE_TIME, t, 4) + element(CUE_AT, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, p, 8))) for t, p in zip(stamps, places, strict=True)))
    place, places = len(info) + len(TRACK_LIST) + len(cues([0] * len(stamps))), []
    for c in clusters:
        places.append(place)
        place += len(c)
    return HEAD + element(SEGMENT, b"".join([info, TRACK_LIST, cues(places), *clusters]))


def number_at(data: bytes, at: int) -> tuple[int, int, bool]:
    """Size at a place: value, place after it, whether all its bits are ones."""
    first = data[at]
    if not first:
        raise ValueError("a size of over eight bytes")
    width = 9 - first.bit_length()
    raw = int.from_bytes(data[at : at + width], "big") & ((1 << 7 * width) - 1)
    if at + width > len(data):
        raise ValueError("cut off in a size")
    return raw, at + width, raw == (1 << 7 * width) - 1


def laced(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames in a block's body."""
    if not kind:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    if kind == 2:
        size = (end - at) // n
        if size * n != end - at:
            raise ValueError("fixed lacing doesn't divide the block")
        return [(at + i * size, size) for i in range(n)]
    sizes: list[int] = []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif n > 1:
        size, at, _ = number_at(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            start = at
            raw, at, _ = number_at(data, at)
            sizes.append(sizes[-1] + raw - ((1 << 7 * (at - start) - 1) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing beyond the block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> Media:
    """Packets and cues of a file; a damaged one raises ValueError, wherever it is cut."""
    try:
        return parsed(data)
    except (IndexError, struct.error, UnicodeDecodeError) as e:
        raise ValueError(f"damaged file: {e}") from e


def parsed(data: bytes) -> Media:
    packets: list[Packet] = []
    cues: list[tuple[int, int, int]] = []
    seen = {"doctype": "", "codec": "", "depth": 0, "duration": 0.0}
    scale, stamp, blocks, clusters, segment = 1_000_000, 0, 0, -1, 0
    cue_time = cue_track = described = default = 0
    lasts: dict[int, int] = {}
    at, ends = 0, [len(data)]
    while at < len(data):
        while len(ends) > 1 and at >= ends[-1]:
            ends.pop()
        if not data[at]:
            raise ValueError("an id of over eight bytes")
        width = 9 - data[at].bit_length()
        number, at = int.from_bytes(data[at : at + width], "big"), at + width
        size, at, unknown = number_at(data, at)
        end = ends[-1] if unknown else at + size
        if end > len(data):
            raise ValueError("cut off in an element")
        if number in MASTERS:
            if number == SEGMENT:
                segment = at
            elif number == CLUSTER:
                clusters += 1
            elif number == TRACK:
                described, default = 0, 0
            ends.append(end)
            continue
        if number in (SIMPLE, BLOCK):
            track, body, _ = number_at(data, at)
            if body + 3 > end:
                raise ValueError("cut off in a block")
            (delta,), flags = struct.unpack_from(">h", data, body), data[body + 2]
            kind = flags >> 1 & 3
            time, blocks = (stamp + delta) * scale, blocks + 1
            for i, (start, length) in enumerate(laced(data, body + 3, end, kind)):
                packets.append(Packet(track, (time + i * lasts.get(track, 0)) // 1_000_000, start, length, LACINGS[kind], clusters))
        elif number == STAMP:
            stamp = int.from_bytes(data[at:end], "big")
        elif number in (NUMBER, LASTS):
            if number == NUMBER:
                described = int.from_bytes(data[at:end], "big")
            else:
                default = int.from_bytes(data[at:end], "big")
            if described and default:  # they come in any order
                lasts[described] = default
        elif number == SCALE:
            scale = int.from_bytes(data[at:end], "big")
        elif number == CUE_TIME:
            cue_time = int.from_bytes(data[at:end], "big")
        elif number == CUE_TRACK:
            cue_track = int.from_bytes(data[at:end], "big")
        elif number == CUE_CLUSTER:
            cues.append((cue_time, cue_track, segment + int.from_bytes(data[at:end], "big")))
        elif number == DURATION:
            seen["duration"] = struct.unpack(">d" if size == 8 else ">f", data[at:end])[0]
        elif number == DEPTH:
            seen["depth"] = int.from_bytes(data[at:end], "big")
        elif number in (CODEC, DOCTYPE):
            seen["codec" if number == CODEC else "doctype"] = data[at:end].decode("ascii")
        at = end
    return Media(packets, cues, blocks=blocks, clusters=clusters + 1, lasts=lasts, **seen)


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join([data[p.start : p.start + p.length] for p in media.packets if p.track == track])


def describe(data: bytes, media: Media) -> str:
    """The feature string: the packet table in short."""
    last = media.packets[-1] if media.packets else Packet(0, 0, 0, 0, "none", 0)
    sound = all(data[p : p + 4] == CLUSTER.to_bytes(4, "big") for _, _, p in media.cues)
    lacing = "+".join(sorted({p.lacing for p in media.packets}))
    return f"{media.doctype} {media.codec} depth={media.depth} packets={len(media.packets)} blocks={media.blocks} clusters={media.clusters} cues={len(media.cues)}{'' if sound else '!'} lacing={lacing} end_ms={last.timestamp + media.lasts.get(last.track, 0) // 1_000_000} duration_ms={media.duration:.0f} last={last.start}+{last.length}"


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): every text as a Matroska file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([write(pad(t.encode())) for t in part.column(1).to_pylist()], pa.binary())], ["doc_id", "media"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, media binary")


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each packet of each file, with its place in the file.

    A damaged file gives one row of nulls with what is wrong in ``error``; a null gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows = [(key, i, *p, None) for i, p in enumerate(parse(data).packets)] if data is not None else []
                except ValueError as e:
                    rows = [(key, *[None] * 7, str(e))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "packet", "track", "timestamp_ms", "start", "length", "lacing", "cluster", "error"]
    kinds = [pa.string() if c in ("lacing", "error") else pa.int64() for c in names]
    schema = "doc_id long, packet long, track long, timestamp_ms long, start long, length long, lacing string, cluster long, error string"
    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, schema)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text, read the stored bytes back, and give digests of both; no shuffle."""

    def row(text: str) -> tuple:
        raw = text.encode()
        stored = write(pad(raw))
        media = parse(stored)
        back = payload_of(stored, media)
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(stored, media)

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                columns = zip(*(row(t) for t in part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
