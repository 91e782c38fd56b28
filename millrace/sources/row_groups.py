"""Single row groups of Parquet files as a data source: a partition for each group, planned from the footers.

Only the listed groups are read, and of these only the asked columns. Files are opened with Arrow's file
systems, so their place must be one that these know (local or mounted folders, HDFS, object stores).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.sources.readers import GateError

#: What is told of each row beside the columns of the file.
PLACE = [T.StructField("_file", T.StringType()), T.StructField("_row_group", T.IntegerType()), T.StructField("_row_index", T.LongType())]
#: Rows of a batch, and footers read at once.
BATCH_ROWS, FOOTERS = 1024, 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if path.startswith("file:") or path.startswith("/"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


class Group(InputPartition):
    """One row group of one file."""

    def __init__(self, file: str, group: int):
        self.file, self.group = file, group


class RowGroupReader(DataSourceReader):
    def __init__(self, schema: T.StructType, wanted: dict[str, list[int] | None]):
        own = schema.fields[: -len(PLACE)]
        self.columns = [f.name for f in own]
        self.zoned = [isinstance(f.dataType, T.TimestampType) for f in own]
        self.wanted = wanted

    def _groups(self, file: str) -> list[int]:
        system, path = opened(file)
        with system.open_input_file(path) as stream:
            there = pq.ParquetFile(stream).metadata.num_row_groups
        groups = self.wanted[file]
        if groups is None:
            return list(range(there))
        if beyond := [g for g in groups if not 0 <= g < there]:
            raise GateError(f"{file} has {there} row groups, not {beyond}")
        return groups

    def partitions(self) -> list[InputPartition]:
        """Footers only: a group for each task."""
        with ThreadPoolExecutor(FOOTERS) as pool:
            found = list(pool.map(self._groups, self.wanted))
        return [Group(file, group) for file, groups in zip(self.wanted, found, strict=True) for group in groups]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        system, path = opened(partition.file)
        at = 0
        with system.open_input_file(path) as stream:
            for batch in pq.ParquetFile(stream).iter_batches(BATCH_ROWS, [partition.group], self.columns):
                n = len(batch)
                columns = [_fitting(batch.column(c), zoned) for c, zoned in zip(self.columns, self.zoned, strict=True)]
                place = [pa.array([partition.file] * n, pa.string()), pa.array([partition.group] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *place], [*self.columns, *[f.name for f in PLACE]])
                at += n


def _fitting(values: pa.Array, zoned: bool) -> pa.Array:
    """Times as Spark has them, in microseconds."""
    return values.cast(pa.timestamp("us", "UTC" if zoned else None), safe=False) if pa.types.is_timestamp(values.type) else values


class RowGroups(DataSource):
    """Option wanted: JSON of file -> list of row groups, or null for all."""

    @classmethod
    def name(cls) -> str:
        return "row_groups"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return RowGroupReader(schema, json.loads(self.options["wanted"]))


def read_row_groups(spark: SparkSession, wanted: dict[str, list[int] | None], columns: list[str] | None = None) -> DataFrame:
    """columns (default: all) of the listed row groups of files, file -> groups (None: all), with _file, _row_group, _row_index.

    Groups must be numbers from 0, in order and none twice; one that a file does not have is an error, found when the
    scan is planned. All files need the columns of the first one. A row of an empty group does not exist.
    """
    if not wanted:
        raise GateError("no files")
    for file, groups in wanted.items():
        if groups is not None and (not groups or any(isinstance(g, bool) or not isinstance(g, int) or g < 0 for g in groups) or sorted(set(groups)) != groups):
            raise GateError(f"row groups of {file}: {groups}")
    known = spark.read.parquet(next(iter(wanted))).schema
    names = columns if columns is not None else known.names
    spark.dataSource.register(RowGroups)
    return spark.read.format("row_groups").schema(T.StructType([*[known[n] for n in names], *PLACE])).option("wanted", json.dumps(wanted)).load()
