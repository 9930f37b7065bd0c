"""Deterministic sharded WARC archives: write, commit by manifest, read back.

Records are range-sorted by page id; each range writes files of its own, one gzip member for
each record, and rolls to the next file once the compressed size reaches ``roll_bytes``.  Names,
headers, dates and digests depend on the records alone, so the same table gives the same bytes.

A task writes under temporary names and returns a manifest row for each finished file.  The
manifest is written as a table first; then the files it names are moved to their final names, a
step that may run again at any time.  Files of tasks that were lost or ran twice are not in the
manifest and never get a final name; readers go by the manifest.

Which records revisit which is decided on digests alone: counts by digest are partly summed
before the shuffle, and the roles travel to the writer in the same range sort as the records,
so the payloads are moved once.  Executors reach the folder through pyarrow's file systems.

Defined results: a null payload is the empty one; payloads of under ``least`` bytes are always
responses; rows that share the smallest page id and the payload are all responses; rows with a
null page id are responses; a null url gets a urn; an empty table gives no file and no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch

ROLL_BYTES, LEAST, LEVEL = 32 << 20, 100, 6
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, number int, temporary string, final string, records long, bytes long, sha256 string"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def place(uri: str) -> tuple:
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file:///{uri.removeprefix('file:/').lstrip('/')}")


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page}:{digest}'.encode()).hexdigest())}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """A response, or a revisit of page ``first`` if that is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if first is None else b"")
    # a line break would end the header early
    target = "".join(c for c in url if c > " ") if url else f"urn:page:{page}"
    head = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": record_id(page, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if page is not None:
        head["X-Page-ID"] = str(page)
    if first is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(first, digest), "X-Refers-To-Page-ID": str(first)}
    return "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in head.items()), "", ""]).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, digest, first) of the records that revisit another."""
    payload = F.coalesce(pages["html"].cast("string"), F.lit(""))
    heads = pages.select(pages["page_id"].cast("long").alias("page_id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).filter((F.col("n") >= least) & F.col("page_id").isNotNull())
    # written, so that the join can split a payload that very many pages share
    first = cut(heads.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first <> last").select("digest", "first"), "first-pages")
    return heads.join(first, "digest").filter("page_id <> first").select("page_id", "digest", "first").distinct()


def write(pages: DataFrame, folder: str, shards: int | None = None, roll_bytes: int = ROLL_BYTES, least: int = LEAST) -> DataFrame:
    """Write the archives under ``folder`` and return their manifest, committed."""
    revisits = cut(roles(pages, least), "roles")
    payload = F.coalesce(pages["html"].cast("string"), F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), F.lit(1).alias("kind"), pages["url"].cast("string").alias("url"), payload.alias("payload"), F.lit(None).cast("long").alias("first"))
    marks = revisits.select("page_id", F.lit(0).alias("kind"), F.col("digest").alias("url"), F.lit("").alias("payload"), "first")
    n = shards or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows without an id are dealt over ranges of their own; equal rows may come in any order, so
    # the payload is the last sort key
    dealt = F.when(F.col("page_id").isNull(), F.xxhash64("url", "payload")).otherwise(0)
    keyed = rows.union(marks).select("page_id", "kind", "url", "payload", "first", dealt.alias("dealt"))
    ordered = keyed.repartitionByRange(n, "page_id", "dealt").sortWithinPartitions("page_id", "dealt", "kind", "url", "payload").drop("dealt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = place(folder)
        shard, number, out = TaskContext.get().partitionId(), 0, None
        fs.create_dir(f"{root}/temporary", recursive=True)
        page_of_marks, firsts = None, {}

        def close() -> pa.RecordBatch:
            out.close()
            row = (shard, number, temporary, f"shard-{shard:06d}-{number:05d}.warc.gz", records, size, digest.hexdigest())
            return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=schema)

        names = ["shard", "number", "temporary", "final", "records", "bytes", "sha256"]
        schema = pa.schema(zip(names, [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()], strict=True))
        for batch in batches:
            for page, kind, url, text, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if page != page_of_marks:
                        page_of_marks, firsts = page, {}
                    firsts[url] = first
                    continue
                body = text.encode()
                own = hashlib.sha256(body).hexdigest()
                data = member(record(page, url, body, own, firsts.get(own) if page == page_of_marks else None))
                if out is None:
                    temporary, records, size, digest = f"temporary/{uuid.uuid4().hex}.warc.gz", 0, 0, hashlib.sha256()
                    out = fs.open_output_stream(f"{root}/{temporary}", compression=None)
                out.write(data)
                digest.update(data)
                records, size = records + 1, size + len(data)
                if size >= roll_bytes:
                    yield close()
                    out, number = None, number + 1
        if out is not None:
            yield close()

    manifest = cut(ordered.mapInArrow(run, MANIFEST), "manifest", batch_rows=None)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileType

        fs, root = place(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if fs.get_file_info(f"{root}/{row['temporary']}").type != FileType.NotFound:
                    fs.move(f"{root}/{row['temporary']}", f"{root}/{row['final']}")
            yield batch

    return cut(manifest.mapInArrow(move, MANIFEST), "committed")


def members(stream) -> Iterator[bytes]:
    """The unpacked gzip members of a file, one at a time."""
    unpack, parts, rest = zlib.decompressobj(31), [], b""
    while chunk := rest or stream.read(1 << 20):
        parts.append(unpack.decompress(chunk))
        rest = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("an archive ends inside a record")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record, checked against its block digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    return fields, block


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """One row for each record of the archives that the manifest names."""

    def row(data: bytes) -> tuple:
        fields, block = parse(data)
        http, _, payload = block.partition(b"\r\n\r\n")
        page, first = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
        kind = fields["WARC-Type"]
        size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
        digest = hashlib.sha256(payload).hexdigest() if kind == "response" else fields["WARC-Payload-Digest"].removeprefix("sha256:")
        if kind == "response" and size != len(payload):
            raise ValueError("a payload's length")
        return page and int(page), size, digest, kind, first and int(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = place(folder)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in members(stream):
                        rows.append(row(data))
                        if len(rows) == 5_000:
                            yield make(rows)
                            rows = []
                if rows:
                    yield make(rows)

    files = manifest.select("final").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "final")
    return files.mapInArrow(run, ROWS)


def archive(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write every page to archives in the shared folder and read them back."""
    folder = scratch(pages.sparkSession, "warc")
    return read(write(pages, folder, least=least), folder)
