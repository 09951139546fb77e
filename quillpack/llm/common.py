"""What the training-data operators share: tables, durable intermediates, null-safe keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one is made only where it is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _local
    _local = _local or tempfile.mkdtemp(prefix="quillpack-")
    return _local


_local = ""
#: Folders written within the scopes that are open, innermost last.
_open: list[list[str]] = []


def stored(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: cuts lineage and survives lost executors.

    The folder goes when the enclosing ``scratch`` ends (unless ``keep``), or ``release`` is told to, or else when the
    driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(held)
    if _open and not keep:
        _open[-1].append(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._quillpack_path = path
    return made


def remove(spark: SparkSession, path: str) -> None:
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)


def release(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote for ``df``; nothing may read it any more."""
    remove(df.sparkSession, df._quillpack_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored within goes at the end; results are to be written, or stored to ``keep``, before."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


def only(df: DataFrame, **types: str) -> DataFrame:
    """Just the named columns, cast; whatever else the table has can't clash with what an operator adds."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()])


def eq(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def parts(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions as the session has them."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
