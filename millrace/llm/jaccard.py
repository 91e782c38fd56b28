"""N-gram Jaccard self-join by the chosen-path method.

A text is its set of distinct five-word shingles. In each run a set chooses a path: at every
level it samples one of its tokens by a hash that all sets share (the smallest hash value), so two
sets choose the same token with a probability equal to their Jaccard similarity. Sets with the same
path so far share a bucket. Buckets of up to SPLIT sets are leaves; larger ones are split by the next
token of the path, up to LEVELS tokens. In the leaves all pairs are compared exactly, and the pairs at
or above the threshold are links. A leaf that is still large after the last level (many sets that are
all alike), or whose texts are long, is compared whole as well, in pairs of blocks of BLOCK sets or
BLOCK_SHINGLES shingles, each pair of blocks a group of its own, so no bucket is capped and no
candidate is dropped.

A pair of similarity s meets in a run with probability s**depth or more. There are as many runs as a pair
at the threshold needs to be found with the target recall even if its bucket is split to the last
level: ten for 0.8 and 0.999. Such a pair is then missed with probability 1e-7 if leaves are of the first
level, 4e-5 at the second and 8e-4 at the third.

Equal sets are one class with a size; copies are never expanded into pairs. A pair that meets in
several leaves counts in the first of them only, which both sets can tell from their lists of leaves,
so counts need no table of pairs. Each leaf returns a count for each set and links to the smallest set
it is connected with there.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components, smallest_ids
from millrace.llm.leaf_pairs import groups, results, tally
from millrace.llm.polyhash import mix
from millrace.llm.scratch import lean, numbered, small, write
from millrace.llm.shingles import WORDS, shingle_sets

THRESHOLD = 0.8
#: The share of pairs at the threshold that have to be found, and the tokens of a path.
RECALL, LEVELS = 0.999, 3
#: Buckets of more sets are split by a further token.
SPLIT = 256
#: Leaves of more sets, or of more shingles in all, are compared in pairs of blocks of about so many.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20
#: Columns of the incidence matrix multiplied at once.
COLUMNS = 2048


def runs_for(threshold: float, recall: float) -> int:
    """How many runs find a pair at the threshold with the target recall, each with threshold**LEVELS at least."""
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("threshold and recall must lie between 0 and 1")
    return 1 if threshold == 1 else math.ceil(math.log(1 - recall) / math.log(1 - threshold**LEVELS))


@functools.lru_cache(maxsize=4)
def _seeds(runs: int) -> np.ndarray:
    return np.random.default_rng(41).integers(1, 1 << 63, runs * LEVELS, dtype=np.uint64)



def _set_hashes(found: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, as signed numbers."""
    one, two = mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(found + np.uint64(0x14057B7EF767814F)))
    return int(np.int64(one)), int(np.int64(two))


def _paths(found: np.ndarray, runs: int) -> list[int]:
    """For each run the keys of its buckets, level by level: runs * LEVELS numbers."""
    seeds = _seeds(runs)
    chosen = [mix(found ^ s).min() for s in seeds]
    keys = np.array(chosen, np.uint64).reshape(runs, LEVELS)
    keys[:, 0] = mix(keys[:, 0] ^ seeds[:runs])
    for level in range(1, LEVELS):
        keys[:, level] = mix(keys[:, level - 1] * np.uint64(3) ^ keys[:, level])
    return keys.ravel().astype(np.int64).tolist()


def _sketch(docs: DataFrame, doc_id: str, text: str, words: int, runs: int) -> DataFrame:
    """For each row: id, n (shingles), a and b (hashes of the set), paths."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, paths = [], [], [], []
            for found in shingle_sets(batch.column(1), words):
                n.append(len(found))
                one, two = _set_hashes(found) if len(found) else (0, 0)
                a.append(one)
                b.append(two)
                paths.append(_paths(found, runs) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(paths, pa.list_(pa.int64()))],
                ["id", "n", "a", "b", "paths"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n int, a long, b long, paths array<long>")


def _leaves(classes: DataFrame, split: int, runs: int) -> DataFrame:
    """From (key, n, paths) to (leaf, members, shingles, key): the leaves of two classes or more, how many members and shingles they have, and the members."""
    one_run = F.explode(F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.slice("paths", r * LEVELS + 1, LEVELS)))
    found, going = None, classes.select("key", "n", one_run.alias("path"))
    for level in range(LEVELS):
        keyed = going.select("key", "n", "path", F.col("path")[level].alias("leaf"))
        # Equal member lists, told by count and two hashes, need comparing once.
        marks = F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y")
        sizes = F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")
        counts = write(keyed.groupBy("leaf").agg(*sizes, *marks).where("members > 1"), "counts")
        last = level == LEVELS - 1
        ends = F.lit(True) if last else F.col("members") <= split
        here = keyed.join(small(counts), "leaf").where(ends).select("leaf", "members", "shingles", "x", "y", "key")
        found = here if found is None else found.unionByName(here)
        hot = counts.df.where(~ends).select("leaf")
        if last or hot.isEmpty():
            break
        going = keyed.join(small(write(hot, "hot")), "leaf").select("key", "n", "path")
    # Of leaves with the same members one remains.
    written = write(found, "leaves").df
    first = small(write(written.groupBy("members", "x", "y").agg(F.min("leaf").alias("leaf")).select("leaf").distinct(), "first"))
    return written.join(first, "leaf").select("leaf", "members", "shingles", "key")


def _incidence(sets: list[np.ndarray]) -> np.ndarray:
    """For each two sets the number of shingles they share."""
    m = len(sets)
    rows = np.repeat(np.arange(m), [len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = times[at] > 1  # a token of one set is in no intersection
    place = np.cumsum(times > 1) - 1
    rows, at = rows[use], place[at[use]]
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    shared = np.zeros((m, m), np.float32)
    width = int(at[-1]) + 1 if len(at) else 0
    for start in range(0, width, COLUMNS):
        low, high = np.searchsorted(at, [start, start + COLUMNS])
        part = np.zeros((m, min(COLUMNS, width - start)), np.float32)
        part[rows[low:high], at[low:high] - start] = 1
        shared += part @ part.T
    return shared


def _compare(rows: DataFrame, threshold: float, words: int) -> DataFrame:
    """rows: leaf, one, two, block, key, size, a, b, leaves, text; sorted by (leaf, one, two) within partitions."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(batches, 3):
            leaf, one, two = (held.column(i)[0].as_py() for i in range(3))
            marks = zip(held.column(4).to_pylist(), held.column(6).to_pylist(), held.column(7).to_pylist(), strict=True)
            sets, chosen, seen = [], [], set()
            for i, ((key, a, b), found) in enumerate(zip(marks, shingle_sets(held.column(9), words), strict=True)):
                # Another row of the same id has another set; equal rows of one id come once.
                if key not in seen and _set_hashes(found) == (a, b):
                    seen.add(key)
                    sets.append(found)
                    chosen.append(i)
            if len(sets) < 2:
                continue
            held = held.take(pa.array(chosen))
            lengths, shared = np.array([len(s) for s in sets]), _incidence(sets)
            linked = shared >= threshold * (lengths[:, None] + lengths[None, :] - shared) - 1e-6
            np.fill_diagonal(linked, False)
            if one != two:  # inside the blocks others compare
                block = held.column(3).to_numpy()
                linked &= block[:, None] != block[None, :]
            if linked.any():
                key, size = held.column(4).to_numpy(), held.column(5).to_numpy()
                yield results(key, *tally(leaf, held.column(8), size, linked), linked)

    return rows.mapInArrow(run, "key long, links long, root long")


def link_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, words: int = WORDS, split: int = SPLIT, block: int = BLOCK, recall: float = RECALL) -> DataFrame:
    """(id, n, a, b, rep, size, links, component): one row for each row of docs.

    doc_id is a whole number. rep is the smallest id among the rows with the same set, size their number,
    links the number of other rows whose similarity reaches the threshold, component the smallest id
    reachable by links. Null, empty and blank texts and rows without an id link with nothing: their
    rep is null, size 1, links 0 and component their own id. Rows that share an id are rows of their
    own, each with its own text. Other columns, whatever their names, are not read. An empty table
    gives an empty frame.
    """
    spark, runs = docs.sparkSession, runs_for(threshold, recall)
    sketch = write(_sketch(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")), "id", "text", words, runs), "sketch").df
    found = sketch.where("n > 0 AND id IS NOT NULL").groupBy("n", "a", "b").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"), F.any_value("paths").alias("paths"))
    # The number of a class is its own: two texts of one id are two classes. Written once, so it stays.
    classes = write(found.withColumn("key", F.monotonically_increasing_id()), "classes").df
    leaves = write(_leaves(classes.select("key", "n", "paths"), split, runs), "members").df
    lists = leaves.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("leaf", "members", "shingles"))).alias("leaves"))
    wanted = small(write(classes.select("rep", "key", "size", "a", "b").join(lists, "key"), "wanted"))
    texts = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text")).join(wanted, "rep")
    leaf = F.col("at.leaf")
    blocks = F.greatest(F.ceil(F.col("at.members") / block), F.ceil(F.col("at.shingles") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("key", leaf), blocks).cast("int")
    spread = texts.select("key", "size", "a", "b", F.col("leaves.leaf").alias("leaves"), "text", F.explode("leaves").alias("at"))
    spread = spread.select("*", leaf.alias("leaf"), own.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    spread = spread.select("leaf", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "key", "size", "a", "b", "leaves", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = spread.repartition(parts, "leaf", "one", "two").sortWithinPartitions("leaf", "one", "two")
    compared = write(_compare(dealt, threshold, words), "found").df
    links = compared.groupBy("key").agg(F.sum("links").alias("links"))
    component = smallest_ids(components(compared.select(F.col("key").alias("a"), F.col("root").alias("b"))), classes)
    decided = classes.select("n", "a", "b", "key", "rep", "size").join(links, "key", "left").join(component, "key", "left").drop("key")
    rows = sketch.select("id", "n", "a", "b").join(small(write(decided, "decided")), ["n", "a", "b"], "left")
    known = F.col("id").isNotNull() & (F.col("n") > 0)
    return rows.select(
        "id",
        "n",
        "a",
        "b",
        F.when(known, F.col("rep")).alias("rep"),
        F.when(known, F.col("size")).otherwise(1).alias("size"),
        F.when(known, F.coalesce("links", F.lit(0)) + F.col("size") - 1).otherwise(0).cast("long").alias("links"),
        F.when(known, F.coalesce("component", "rep")).otherwise(F.col("id")).alias("component"),
    )


def decisions(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, class_id, n_links, component_id, kept."""
    found = link_classes(docs, threshold=threshold)
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("rep", "id").alias("class_id"),
        F.col("links").alias("n_links"),
        F.col("component").alias("component_id"),
        F.col("component").eqNullSafe(F.col("id")).alias("kept"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The row with the smallest doc_id of each group of linked rows, and all rows that link with nothing; the columns of docs, whatever their names."""
    plain, own = numbered(docs)
    dropped = link_classes(plain, own["doc_id"], own["text"], threshold=threshold).where("component <> id").select(F.col("id").alias("_mr_drop")).distinct()
    return plain.join(small(write(dropped, "dropped")), F.col(own["doc_id"]) == F.col("_mr_drop"), "left_anti").toDF(*docs.columns)
