"""The packed stream of a corpus: what follows on each token, and training windows, without a task that holds a split.

Records (split, record_id, tokens, mask) are one stream for each split, in record_id order. tokens are
little-endian numbers of 16 bits, mask has a byte for each token: 1 if it is a target.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import seeded
from millrace.operators.selection import running_offset
from millrace.operators.tokens import VOCABULARY
from millrace.sources.flat_shards import values, wrong_value
from millrace.sources.readers import GateError, demand_none
from millrace.sources.staging import settle

#: Tokens of the cells by which windows find their records.
CELL = 4096
#: Draws of a window before it is an error that none has a target.
ATTEMPTS = 10_000


def next_tokens(records: DataFrame, vocabulary: int = VOCABULARY) -> DataFrame:
    """split, token, target, n, n_eligible: how often a token is followed by another in the stream, and how often that one is a target.

    Pairs across the border of two records count too. Each range partition counts its own pairs in one pass
    and tells its first and last token; the pair across a border of partitions comes from the first token of the
    next partition of the split. Records without tokens change nothing. A token outside the vocabulary
    and a mask that does not fit are errors.
    """
    rows = records.select("split", "record_id", "tokens", "mask").repartitionByRange("split", "record_id").sortWithinPartitions("split", "record_id")
    names = ["split", "part", "token", "target", "n", "n_eligible"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found, ends = TaskContext.get().partitionId(), {}, {}
        for batch in batches:
            at = 0
            for split, run in groupby(batch.column(0).to_pylist()):
                n = len(list(run))
                own = batch.slice(at, n)
                at += n
                tokens, mask = values(own.column(1), "<u2").astype(np.int64), values(own.column(2), "u1")
                if error := wrong_value(tokens, mask, vocabulary):
                    raise GateError(error)
                if not len(tokens):
                    continue
                if split in ends:
                    tokens, mask = np.append(ends[split][2], tokens), np.append(np.uint8(0), mask)
                else:
                    ends[split] = [int(tokens[0]), int(mask[0]), 0]
                    found[split] = np.zeros((2, vocabulary * vocabulary), np.int64)
                ends[split][2] = int(tokens[-1])
                pairs = tokens[:-1] * vocabulary + tokens[1:]
                found[split][0] += np.bincount(pairs, minlength=vocabulary * vocabulary)
                found[split][1] += np.bincount(pairs[mask[1:] == 1], minlength=vocabulary * vocabulary)
        for split, counts in found.items():
            pair = np.flatnonzero(counts[0])
            # The last row tells the ends: first token, last token, whether the first is a target.
            first, target, last = ends[split]
            columns = [np.append(pair // vocabulary, first), np.append(pair % vocabulary, last), np.append(counts[0][pair], -1), np.append(counts[1][pair], target)]
            columns = [[split] * (len(pair) + 1), [part] * (len(pair) + 1), *columns]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    parts = settle(rows.select("split", "tokens", "mask").mapInArrow(count, "split string, part int, token int, target int, n long, n_eligible long"))
    following = lambda c: F.lead(c).over(W.partitionBy("split").orderBy("part"))
    ends = parts.where("n < 0")  # a row for each partition and split
    border = ends.select("split", F.col("target").alias("token"), following("token").alias("target"), F.lit(1).cast("long").alias("n"), following("n_eligible").alias("n_eligible"))
    pairs = parts.where("n > 0").drop("part").unionByName(border.where("target IS NOT NULL"))
    return pairs.groupBy("split", "token", "target").agg(F.sum("n").alias("n"), F.sum("n_eligible").alias("n_eligible"))


def _cells(rows: DataFrame, first: str, last: str) -> DataFrame:
    """A row for each cell that tokens first to last touch."""
    at = lambda c: F.floor(F.col(c) / CELL)
    return rows.withColumn("_low", at(first)).withColumn("_cell", F.explode(F.sequence("_low", at(last))))


def cut_windows(starts: DataFrame, placed: DataFrame, block: int) -> DataFrame:
    """starts (split, draw, start) with tokens and mask: block + 1 tokens from start on.

    placed: records with offset and n_tokens. Windows and records meet in cells of the stream, each pair in the
    first cell that both touch; what records give is cut out before it is shuffled.
    """
    wanted = _cells(starts.withColumn("_end", F.col("start") + block), "start", "_end").withColumnRenamed("_low", "_w")
    there = _cells(placed.where("n_tokens > 0").withColumn("_stop", F.col("offset") + F.col("n_tokens") - 1), "offset", "_stop")
    met = wanted.join(there, ["split", "_cell"]).where((F.col("_cell") == F.greatest("_w", "_low")) & (F.col("offset") <= F.col("_end")) & (F.col("_stop") >= F.col("start")))
    low = F.greatest("start", "offset")
    size, skip = F.least("_end", "_stop") - low + 1, low - F.col("offset")
    tokens = F.substring("tokens", (2 * skip + 1).cast("int"), (2 * size).cast("int"))
    piece = F.struct(low.alias("at"), tokens.alias("tokens"), F.substring("mask", (skip + 1).cast("int"), size.cast("int")).alias("mask"))
    # A window is of block + 1 tokens, so it has no more pieces.
    lists = met.select("split", "draw", "start", piece.alias("p")).groupBy("split", "draw", "start").agg(F.array_sort(F.collect_list("p")).alias("p"))
    whole = lambda c: F.aggregate("p", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x[c])).alias(c)
    return lists.select("split", "draw", "start", whole("tokens"), whole("mask"))


def training_windows(records: DataFrame, seed: str, draws: int, block: int = 256) -> DataFrame:
    """split, draw, attempt, start, tokens, mask: for each split so many windows of block predictions, each with at least one target.

    Draw d of a split begins at the seeded hash of split:d:attempt modulo the places there are, with the first
    attempt whose window has a target behind its first token. A split too short for a window, or without any
    target, and two rows of one record_id are errors. Windows may overlap and repeat, as drawn ones do.
    """
    spark = records.sparkSession
    demand_none(records.groupBy("split", "record_id").count().where("count > 1"), "repeated records")
    ids = running_offset(records.select("split", "record_id", F.length("mask").alias("n_tokens")), "record_id", F.col("n_tokens"), ["split"])
    placed = settle(records.select("split", "record_id", "tokens", "mask").join(ids, ["split", "record_id"]))
    sums = settle(placed.groupBy("split").agg(F.sum("n_tokens").alias("total"), F.max(F.locate("\x01", F.col("mask").cast("string"))).alias("target")))
    if not (short := sums.where((F.col("total") < block + 1) | (F.col("target") == 0))).isEmpty():
        raise GateError(f"no windows in {[r.split for r in short.limit(5).collect()]}")
    left = sums.select("split", "total", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")) if draws > 0 else spark.createDataFrame([], "split string, total long, draw int")
    found, attempt = None, 0
    while not left.isEmpty():
        if attempt == ATTEMPTS:
            raise GateError("no window with a target was drawn")
        head = F.conv(F.substring(seeded(seed, F.concat_ws(":", "split", "draw", F.lit(attempt))), 1, 15), 16, 10).cast("long")
        drawn = left.withColumn("start", head % (F.col("total") - block))
        cut = settle(cut_windows(drawn.select("split", "draw", "start"), placed, block))
        good = F.locate("\x01", F.substring("mask", 2, block).cast("string")) > 0
        done = cut.where(good).select("split", "draw", F.lit(attempt).alias("attempt"), "start", "tokens", "mask")
        found = done if found is None else found.unionByName(done)
        left = settle(left.join(cut.where(good).select("split", "draw"), ["split", "draw"], "left_anti"))
        attempt += 1
    return found if found is not None else placed.select("split", F.lit(0).alias("draw"), F.lit(0).alias("attempt"), F.col("offset").alias("start"), "tokens", "mask").limit(0)
