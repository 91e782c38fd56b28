"""Tables written between steps, in the folder that driver and executors share.

A written table cuts the lineage, survives the loss of executors and has a known size,
so a broadcast can be decided by measuring instead of guessing.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.polyhash import forget_powers

#: A side is broadcast only if its rows hold no more than this many bytes, as files and unpacked.
BROADCAST_BYTES = 8 << 20
UNPACKED_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, one of our own on a local master (tests), else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ... and the new name of each: names with dots, or like ours, cannot get in the way."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


class Written(NamedTuple):
    """A table in the shared folder and the bytes of its files."""

    df: DataFrame
    path: str
    bytes: int


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


#: Whether a query's shuffle files go when it has ended, instead of when the driver next collects its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, tag: str, tidy: bool = False) -> Written:
    """Write df as Parquet to the shared folder and read it back. tidy: its shuffle files go with the end of the writing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, None)
    if tidy:
        spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    files, place = _file_system(spark, path)
    return Written(spark.read.schema(df.schema).parquet(path), path, files.getContentSummary(place).getLength())


def forget(spark: SparkSession, *tables: Written) -> None:
    """Remove written tables that no later plan reads."""
    for table in tables:
        files, place = _file_system(spark, table.path)
        files.delete(place, True)


def _width(name: str, kind: T.DataType) -> Column:
    """About the bytes of a value in memory."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 24
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        each = 8 * len(inner.fields) + 24 if isinstance(inner, T.StructType) else 8
        return F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0)) * each + 24
    return F.lit(16)


def small(table: Written, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The table with a broadcast hint if it is small enough as files and unpacked, else as it is (a shuffled join)."""
    if table.bytes > limit:
        return table.df
    widths = sum((_width(f.name, f.dataType) for f in table.df.schema.fields), F.lit(16))
    unpacked = table.df.agg(F.sum(widths.cast("long"))).first()[0] or 0
    return F.broadcast(table.df) if unpacked <= UNPACKED_BYTES else table.df


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system: workers are kept for later stages."""
    forget_powers()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        return


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over the batches of a task that releases memory when the task ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
