"""Digests of ordered streams that compose: the digest of a whole follows from those of its parts, in order.

A stream of elements x1 ... xn has h = x1 * B**(n-1) + ... + xn modulo a prime, for two bases. Of two
streams one after the other it is h1 * B**n2 + h2, so partitions are folded for themselves and then
combined by how much stands behind each. Equal streams have equal digests however they are cut; a
stream of other elements, of another order, or with one element twice has another digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.sources.staging import settle

PRIME = (1 << 61) - 1
# The bases.
BASES = (1_152_921_504_606_846_883, 2_008_726_311_405_797_531)


class Digest(NamedTuple):
    """n elements and the two residues."""

    n: int = 0
    a: int = 0
    b: int = 0

    def then(self, sha256: str) -> Digest:
        """With one more element, named by a hexadecimal SHA-256 (of which 120 bits count)."""
        return Digest(self.n + 1, (self.a * BASES[0] + int(sha256[:15], 16)) % PRIME, (self.b * BASES[1] + int(sha256[15:30], 16)) % PRIME)

    def before(self, other: Digest) -> Digest:
        """Of this stream and the other one behind it."""
        a, b = self.shifted(other.n)
        return Digest(self.n + other.n, (a + other.a) % PRIME, (b + other.b) % PRIME)

    def shifted(self, n: int) -> tuple[int, int]:
        """The residues with n elements behind."""
        return self.a * pow(BASES[0], n, PRIME) % PRIME, self.b * pow(BASES[1], n, PRIME) % PRIME

    def hex(self) -> str:
        return f"{self.a:016x}{self.b:016x}"


def stream_digests(rows: DataFrame, group: str, order: str, mark: Column) -> DataFrame:
    """group, records, digest: of each group's rows in the order of a column, where mark (hexadecimal SHA-256) names a row.

    Rows of one place in the order count in the order of their marks. Rows are dealt by ranges, each partition is
    folded in one pass, and a row for each partition and group is combined by windows and sums.
    """
    kind = rows.schema[group].dataType.simpleString()
    sorted_ = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), mark.alias("m")).repartitionByRange("g", "o").sortWithinPartitions("g", "o", "m")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            for g, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[g] = found.get(g, Digest()).then(m)
        part = TaskContext.get().partitionId()
        columns = [list(found), [part] * len(found), *([d[i] for d in found.values()] for i in range(3))]
        kinds = [batch_type(kind), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["g", "part", "n", "a", "b"])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, n, a, b, behind = (c.to_pylist() for c in batch.columns)
            moved = [Digest(0, x, y).shifted(z) for x, y, z in zip(a, b, behind, strict=True)]
            residues = [pa.array([m[i] for m in moved], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *residues], ["g", "n", "a", "b"])

    parts = settle(sorted_.select("g", "m").mapInArrow(fold, f"g {kind}, part int, n long, a long, b long"))
    behind = F.coalesce(F.sum("n").over(W.partitionBy("g").orderBy("part").rowsBetween(1, W.unboundedFollowing)), F.lit(0))
    moved = parts.select("g", "n", "a", "b", behind.alias("behind")).mapInArrow(shift, f"g {kind}, n long, a long, b long")
    whole = lambda c: F.lower(F.lpad(F.hex((F.sum(F.col(c).cast("decimal(38,0)")) % PRIME).cast("long")), 16, "0"))
    return moved.groupBy("g").agg(F.sum("n").alias("records"), F.concat(whole("a"), whole("b")).alias("digest")).withColumnRenamed("g", group)


def batch_type(kind: str) -> pa.DataType:
    """The Arrow type of a group column."""
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]
