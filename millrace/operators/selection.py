"""Choosing rows: first of a group, hash ranks, byte budgets, prefix sums that no single task holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions.text import seeded
from millrace.sources.readers import GateError, demand_none
from millrace.sources.staging import settle

#: Groups of more rows are not walked by one task.
HOT_ROWS = 1_000_000


def first_of_group(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The first row of each group. Map tasks keep one row of a group each, so a hot group arrives combined."""
    first = rows.groupBy(*group).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r"))
    return first.select("r.*")


def conflicts(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """Keys with more than one payload: key, n_payloads, n_rows."""
    found = rows.groupBy(key).agg(F.countDistinct(payload).alias("n_payloads"), F.count(F.lit(1)).alias("n_rows"))
    return found.where("n_payloads > 1")


def top_by_hash(rows: DataFrame, seed: str, key: str, k: int, group: list[str] | None = None) -> DataFrame:
    """The k rows with the smallest seeded hash (then key), of each group or of all, with rank."""
    ranked = rows.withColumn("hash", seeded(seed, F.col(key)))
    if not group:  # the k best only reach the window
        ranked = ranked.orderBy("hash", key).limit(k)
    order = W.partitionBy(*(group or [])).orderBy("hash", key)
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exactly_per_group(rows: DataFrame, seed: str, key: str, group: str, wanted: dict[str, int]) -> DataFrame:
    """key, group, position: of each group exactly so many rows, those with the smallest seeded hashes, then all in the order of group and key.

    A group with fewer rows, or rows of one key, is an error. Positions count from 0 over the chosen rows alone.
    """
    most = max(wanted.values(), default=0)
    ranked = settle(top_by_hash(rows.where(F.col(group).isin(*wanted)).select(key, group), seed, key, most, [group]))
    limit = F.coalesce(*[F.when(F.col(group) == g, n) for g, n in wanted.items()]) if wanted else F.lit(0)
    chosen = settle(ranked.where(F.col("rank") <= limit).select(key, group))
    counts = {r[0]: r[1] for r in chosen.groupBy(group).count().collect()}  # a row for each wanted group
    if short := [g for g, n in wanted.items() if counts.get(g, 0) < n]:
        raise GateError(f"not enough rows of {short}")
    demand_none(chosen.groupBy(key).count().where("count > 1"), "keys chosen twice")
    return running_offset(chosen.withColumn("_at", F.struct(group, key)), "_at", F.lit(1)).select(key, group, F.col("offset").alias("position"))


def within_budget(rows: DataFrame, seed: str, group: str, key: str, size: str, content: str, most: int, budget: int, hot: int = HOT_ROWS) -> DataFrame:
    """Greedy choice by seeded hash: of each group the rows in hash order whose size still fits, up to most rows.

    A row that does not fit is passed over and the walk goes on; of equal contents the first counts. Groups of up
    to hot rows are walked in one pass over partitions sorted by group and hash, with what is left of the budget
    carried from batch to batch, so nothing is held. Larger groups go by prefix sums, see in_rounds.
    Returns (group, key, size).
    """
    names = {"g": F.col(group), "k": F.col(key), "s": F.col(size).cast("long"), "c": F.col(content), "h": seeded(seed, F.col(key))}
    walk = rows.select(*[c.alias(name) for name, c in names.items()])
    walk = settle(walk.groupBy("g", "c").agg(F.min_by(F.struct("h", "k", "s"), F.struct("h", "k")).alias("r")).select("g", "r.*"))
    large = settle(walk.groupBy("g").count().where(F.col("count") > hot).select(F.col("g").alias("_g")))
    several = not large.isEmpty()
    same = F.col("g").eqNullSafe(F.col("_g"))
    usual = walk.join(large, same, "left_anti") if several else walk
    kinds = ", ".join(f"{c} {walk.schema[c].dataType.simpleString()}" for c in ("g", "k", "s"))
    sorted_ = usual.where(F.col("s") <= budget).repartition("g").sortWithinPartitions("g", "h", "k").select("g", "k", "s")
    chosen = sorted_.mapInArrow(lambda batches: _walked(batches, most, budget), kinds)
    if several:
        chosen = chosen.unionByName(in_rounds(walk.join(large, same, "left_semi"), most, budget))
    return chosen.select(F.col("g").alias(group), F.col("k").alias(key), F.col("s").alias(size))


def _walked(batches: Iterator[pa.RecordBatch], most: int, budget: int) -> Iterator[pa.RecordBatch]:
    """The rows (g, k, s) of sorted batches that the walk takes."""
    now, left, places = None, budget, most
    for batch in batches:
        if not len(batch):
            continue
        coded = pc.run_end_encode(batch.column(0))
        ends, sizes, taken, at = coded.run_ends.to_pylist(), batch.column(2).to_numpy(), [], 0
        for end, g in zip(ends, coded.values, strict=True):
            if now is None or not g.equals(now):
                now, left, places = g, budget, most
            open_ = np.arange(at, end)
            while places > 0 and len(open_ := open_[sizes[open_] <= left]):
                # The longest run that fits as a whole; what follows it does not fit and is passed over.
                n = min(int(np.searchsorted(np.cumsum(sizes[open_]), left, side="right")), places)
                taken.append(open_[:n])
                left, places, open_ = left - int(sizes[open_[:n]].sum()), places - n, open_[n:]
            at = end
        if taken:
            yield batch.take(pa.array(np.concatenate(taken)))


def in_rounds(walk: DataFrame, most: int, budget: int) -> DataFrame:
    """The same choice for rows (g, k, s, h) of groups that no task should walk alone.

    A round takes the longest run of rows that fits as a whole, found by prefix sums over ranges of the
    order, and then leaves out what can never fit again; so rounds are as few as the times that the walk
    is stopped by a large row, and no task holds a group.
    """
    open_ = walk.where((F.col("s") <= budget) & (F.lit(most) > 0))
    left = settle(open_.select("g", "k", "s", "h", F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("n")))
    chosen = left.select("g", "k", "s").limit(0)
    while not left.isEmpty():
        placed = running_offset(left, "h", F.col("s"), ["g"]).withColumnRenamed("offset", "before")
        placed = running_offset(placed, "h", F.lit(1), ["g"])
        fits = (F.col("before") + F.col("s") <= budget - F.col("used")) & (F.col("offset") < most - F.col("n"))
        placed = settle(placed.withColumn("fits", fits))
        chosen = chosen.unionByName(placed.where("fits").select("g", "k", "s"))
        taken = placed.where("fits").groupBy("g").agg(F.sum("s").alias("more"), F.count(F.lit(1)).alias("rows"))
        rest = placed.where("NOT fits").join(taken.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g")))
        rest = rest.select("g", "k", "s", "h", (F.col("used") + F.col("more")).alias("used"), (F.col("n") + F.col("rows")).alias("n"))
        left = settle(rest.where((F.col("s") <= budget - F.col("used")) & (F.col("n") < most)))
    return chosen


def running_offset(rows: DataFrame, key: str, size: Column, group: list[str] | None = None) -> DataFrame:
    """rows with offset: the sum of size over the rows of the group before this one in key order.

    Rows are dealt to partitions by ranges of (group, key); sums run within a partition, and a window
    over one row for each partition and group adds what stands before it. Null keys come first; rows
    of equal keys follow each other by size. Rows should be narrow: they are written once.
    """
    group = group or []
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_size", size.cast("long")).repartitionByRange(parts, *group, key)
    cut = settle(dealt.withColumn("_part", F.spark_partition_id()))
    before = lambda part, order, of: F.coalesce(F.sum(of).over(W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = cut.groupBy(*group, "_part").agg(F.sum("_size").alias("_sum"))
    keys = [F.col(g).alias(f"_{g}") for g in group]
    sums = sums.select(*keys, F.col("_part").alias("_p"), before(group, ["_part"], "_sum").alias("_b"))
    same = cut["_part"] == sums["_p"]
    for g in group:
        same &= cut[g].eqNullSafe(sums[f"_{g}"])
    within = before([*group, "_part"], [key, "_size"], "_size")
    return cut.join(sums, same).withColumn("offset", F.col("_b") + within).drop("_size", "_part", "_p", "_b", *[f"_{g}" for g in group])
