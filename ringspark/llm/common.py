"""What the operators share: the shared folder, written cuts of lineage, text access."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 500


def worker_cache(name: str) -> dict:
    """A dict that the Python worker keeps between tasks; callers bound its size.

    A worker keeps one such dict: the first call under another name drops it, and gives the
    memory that earlier stages used in this process back to the machine.
    """
    home = sys.modules.setdefault("_ringspark_worker", types.ModuleType("_ringspark_worker"))
    held = home.__dict__.setdefault("held", {})
    if name not in held:
        held.clear()
        give_back()
        held[name] = {}
    return held[name]


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def raw_texts(column: pa.Array) -> Iterator[memoryview]:
    """The UTF-8 bytes of each text of a column without nulls, where they lie."""
    if not len(column):
        return
    _, ends, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(ends, dtype=kind)[column.offset : column.offset + len(column) + 1].tolist()
    whole = memoryview(data if data is not None else b"")
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield whole[a:b]


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset on a single machine (tests), an own one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not getattr(sc, "_ringspark_shared", None):
        sc._ringspark_shared = "file://" + tempfile.mkdtemp(prefix="ringspark-")
    return sc._ringspark_shared


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/ringspark/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str, batch_rows: int | None = BATCH_ROWS) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    A lost executor costs the tasks that ran on it, never the tables that were cut before.  The
    shuffle files behind the table are let go of as soon as it is written.  Rows go to Python in
    batches of at most ``batch_rows`` (None: as the session has it), as whole texts are wide and
    both sides hold a batch.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    before = {CLEANUP: spark.conf.get(CLEANUP, "false"), BATCH: spark.conf.get(BATCH)}
    spark.conf.set(CLEANUP, "true")
    if batch_rows and not 0 < int(before[BATCH]) <= batch_rows:
        spark.conf.set(BATCH, str(batch_rows))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._ringspark_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by :func:`cut` that no later plan reads."""
    for df in frames:
        delete(df.sparkSession, df._ringspark_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): only these two columns are read; a null text becomes the empty one."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(id_col: str, of: int):
    """crc32 of the id as text, modulo ``of``; a null id counts as the text ``null``."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), F.lit(of))


def labelled(features: DataFrame, labels: DataFrame, label: str, keep, rows: int) -> list:
    """At most ``rows`` labelled rows of a narrow table, the same ones in every run.

    Ids are drawn first, by a hash that the number of labelled ids sets the limit of, so that
    only about ``rows`` ids are broadcast and only their rows are sorted.  An id that is labelled
    twice counts once, with the larger label; an id with several rows brings them all, up to
    ``rows``.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    marks = marks.filter(keep).groupBy("doc_id").agg(F.max("y").alias("y"))
    drawn = drawn_ids(marks, marks.count(), rows)
    return features.join(F.broadcast(drawn), "doc_id").orderBy(F.xxhash64("doc_id"), *features.columns).limit(rows).collect()


def drawn_ids(marks: DataFrame, n: int, rows: int) -> DataFrame:
    """About ``rows`` of ``n`` rows by a hash of doc_id: fewer by four deviations, or all if there are no more."""
    if n <= rows:
        return marks
    share = max(rows - 4 * rows**0.5, 1) / n
    return marks.filter(F.xxhash64("doc_id", F.lit("drawn")) < int((2 * share - 1) * 2**63))
