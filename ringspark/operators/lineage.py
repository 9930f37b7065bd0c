"""Tables between the rounds of iterative operators, and column names that no input has."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only on a single machine without one (tests), an own one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not getattr(sc, "_ringspark_rounds", None):
        sc._ringspark_rounds = "file://" + tempfile.mkdtemp(prefix="ringspark-")
    return sc._ringspark_rounds


def held(df: DataFrame, label: str = "round") -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage ends there, and its size is known."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/ringspark/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ringspark_path = path
    return out


def released(*frames: DataFrame) -> None:
    """Delete tables made by :func:`held` that no later plan reads."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._ringspark_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def under(spark: SparkSession, own: dict[str, str]) -> Iterator[None]:
    """Settings that hold for what runs inside."""
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Column names that ``df`` does not have, in any case, made from ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)
